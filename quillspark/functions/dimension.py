"""Small rule tables as array literals: documents are then read once, and nothing is joined or crossed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a rule table at most; a larger one is no rule table and is refused.
MOST = 5000


def as_array(table: DataFrame, *cols: str) -> Column:
    """The table's rows as an array of structs, in the table's order by its columns. Refuses more than MOST rows."""
    cols = cols or tuple(table.columns)
    rows = table.select(*cols).limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"a rule table has over {MOST} rows")
    kinds = {f.name: f.dataType for f in table.select(*cols).schema.fields}
    whole = "array<struct<" + ",".join(f"`{c}`:{kinds[c].simpleString()}" for c in cols) + ">>"

    def value(v, kind):
        return F.array(*map(F.lit, v)).cast(kind) if isinstance(v, list) else F.lit(v).cast(kind)

    return F.array(*(F.struct(*(value(r[c], kinds[c]).alias(c) for c in cols)) for r in rows)).cast(whole)
