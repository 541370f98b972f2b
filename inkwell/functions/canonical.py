"""Hashes of JSON texts that don't depend on how they are written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_hash(text: Column) -> Column:
    """SHA-256 of the value with sorted keys and without blanks; a number that isn't finite raises. Null stays null.

    The function is shipped whole, so workers needn't be able to import this package.
    """
    import pandas as pd

    def run(texts: pd.Series) -> pd.Series:
        import hashlib
        import json

        def refuse(name):
            raise ValueError(f"{name} can't be hashed")

        def one(value):
            whole = json.dumps(json.loads(value, parse_constant=refuse), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
            return hashlib.sha256(whole.encode()).hexdigest()

        return texts.map(one, na_action="ignore")

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, T.StringType())(text)
