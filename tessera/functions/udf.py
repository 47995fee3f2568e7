"""Operators as functions of a collection, for apply_values: udf.top(3, "x") stands for lambda p: p.top(3, "x")."""

from tessera.core import Collection


def __getattr__(name: str):
    if name.startswith("_") or not callable(getattr(Collection, name, None)):
        raise AttributeError(name)

    def curried(*args, **options):
        return lambda p: getattr(p, name)(*args, **options)

    return curried
