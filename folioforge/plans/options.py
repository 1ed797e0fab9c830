"""Argument tables: the tokens of many command lines become options, one row a line.

A name that takes a value takes the next token, whatever that is, another name too. So whether a token is a name or a value hangs on the
tokens before it; it is a value exactly if an odd number of names that take one stand right before it, which a window tells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The names that are set or not, and those that take a value, with the columns they fill.
SWITCHES = {"--dry-run": "dry_run", "--force": "force"}
VALUES = {"--area": "area", "--plataforma": "platform", "--estado": "status", "--titulo": "title"}
#: Of a push of one file, which has no positionals but its file and overlooks other names.
PUSH_VALUES = {"--modulo": "module", "--media": "media", "--parent": "parent_id"}


def token_roles(tokens: DataFrame, key: str = "run_id", switches: dict = SWITCHES, values: dict = VALUES) -> DataFrame:
    """`tokens` (key, pos from 0 without gaps, token) with `role` (switch, name, value or positional), `place` (a positional's number from 0) and
    `taken` (a name's value; null for a name that ends its line)."""
    w = Window.partitionBy(key).orderBy("pos")
    names = _in(F.col("token"), values)
    before = F.coalesce(F.last(F.when(~names, F.col("pos")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    x = tokens.withColumn("is_value", (F.col("pos") - 1 - before) % 2 == 1).withColumn("taken", F.lead("token").over(w))
    role = F.when(F.col("is_value"), "value").when(names, "name").when(_in(F.col("token"), switches), "switch").otherwise("positional")
    x = x.withColumn("role", role).withColumn("taken", F.when(F.col("role") == "name", F.col("taken")))
    place = F.sum((F.col("role") == "positional").cast("int")).over(w) - 1
    return x.withColumn("place", F.when(F.col("role") == "positional", place)).drop("is_value")


def _in(token, names: dict):
    return F.coalesce(token.isin(list(names)), F.lit(False)) if names else F.lit(False)


def parse_options(tokens: DataFrame, key: str = "run_id", positionals: tuple[str, ...] = ("docx_path", "module"), needed: int = 1, switches: dict = SWITCHES, values: dict = VALUES) -> DataFrame:
    """(key, a text column for each positional and value, a boolean for each switch, problem) of command lines.

    Of a value that is given twice the last counts, of a positional all beyond the named ones are left out. A line without its `needed`
    first positionals, or with an empty one there, has the problem `usage`. A line without tokens has no row; its caller knows it.
    """
    x = token_roles(tokens, key, switches, values)
    at = lambda i: F.max(F.when(F.col("place") == i, F.col("token")))
    given = [at(i).alias(name) for i, name in enumerate(positionals)]
    given += [F.max_by("taken", F.when((F.col("role") == "name") & (F.col("token") == n), F.col("pos"))).alias(c) for n, c in values.items()]
    given += [F.coalesce(F.max((F.col("role") == "switch") & (F.col("token") == n)), F.lit(False)).alias(c) for n, c in switches.items()]
    missing = F.lit(False)
    for name in positionals[:needed]:
        missing = missing | (F.coalesce(F.col(name), F.lit("")) == "")
    return x.groupBy(key).agg(*given).withColumn("problem", F.when(missing, "usage"))
