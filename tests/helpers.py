"""Small files and tables for tests."""

from __future__ import annotations

import numpy as np

from surveyloom.plans import encode


def basic(**options) -> encode.Survey:
    channels = [("Fiducial", 3, 1), ("Easting", 5, 1), ("Depths", 5, 3)]
    cells = {(0, 0): [1, 2, 3], (0, 1): [10.0, 20.0, -1e32], (0, 2): np.arange(9.0), (1, 0): [4, 5], (1, 1): [30.0, 40.0]}
    return encode.Survey(channels, [("L100", 100), ("L200", 200)], cells, **options)


def write(tmp_path, survey, name: str = "a.survey") -> str:
    path = tmp_path / name
    path.write_bytes(encode.encode(survey) if isinstance(survey, encode.Survey) else survey)
    return str(path)


def rows(df, *columns: str) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
