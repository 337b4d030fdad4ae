"""Arrow batches in small slices: a batch has 10,000 rows whatever they hold, and their Python objects take many times its size."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa

ROWS = 64


def sliced(of: Callable[..., pa.Array], *arrays: pa.Array) -> pa.Array:
    """``of`` the arrays, by so many rows at a time; a row depends on no other."""
    parts = [of(*(a.slice(i, ROWS) for a in arrays)) for i in range(0, len(arrays[0]), ROWS)]
    return pa.concat_arrays(parts) if parts else of(*arrays)
