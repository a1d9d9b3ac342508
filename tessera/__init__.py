"""Spark-native analytics for single-cell count data."""

from typing import Any

__all__ = ["DE", "Pseudobulk", "SingleCell", "concat_obs", "concat_var"]


def __getattr__(name: str) -> Any:
    # On first use, so that Python workers, which need the operators alone, start fast.
    if name in __all__:
        from tessera import dataset, pseudobulk

        return getattr(pseudobulk if name in ("DE", "Pseudobulk") else dataset, name)
    raise AttributeError(name)
