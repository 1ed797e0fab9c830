"""A markdown corpus made from the test tables by concatenation, written once for both engines.

The tables hold plain prose, so each conversation becomes a document: its first turn opens a module, later ones sections,
and what follows a turn's text depends on conv_id, so that every kind of unit occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_N = "||chr(10)||"

#: One turn's markdown, in SQL that Spark and DuckDB both take.
PIECE = f"""
CASE WHEN turn = 0 AND conv_id % 5 = 0
     THEN '# Contenido'{_N}chr(10)||'[Uno](#uno) [2](#a)'{_N}chr(10)||'[Dos](#dos)'{_N}chr(10)||'[Tres](#tres)'{_N}chr(10)||'# Módulo '||conv_id||' Introducción'{_N}chr(10)
     WHEN turn = 0 THEN '# Módulo '||conv_id||' Introducción a TypeScript {{#m'||conv_id||'}}'{_N}chr(10)
     WHEN turn = 4 THEN '# Segunda parte de '||conv_id{_N}chr(10)
     ELSE '## Paso '||turn||' de **'||role||'**'{_N}chr(10) END
||coalesce(text, ''){_N}chr(10)
||CASE CAST(conv_id % 6 AS INT)
  WHEN 0 THEN 'const x_'||turn||' = '||conv_id||';'{_N}chr(10)||'count: '||turn{_N}chr(10)||'}};'{_N}chr(10)||'const url ='{_N}'"https://example.com/'||conv_id||'"; // nota'{_N}chr(10)
  WHEN 1 THEN '- item '||turn||' con **negrita** y *énfasis*'{_N}'    - sub \\*literal\\*'{_N}'            - muy hondo'{_N}'- fin `code span`'{_N}chr(10)||'Texto ![](./media/image'||turn||'.png){{width="3in"}} después ![alt](media/foto.jpg)'{_N}chr(10)
  WHEN 2 THEN '> const y = '||turn||';'{_N}'>'{_N}'> let z = 2;'{_N}chr(10)||'```js'{_N}'let q = 1; // nota'{_N}'```'{_N}chr(10)||'{{"k": '||turn||'}}'{_N}chr(10)||'{{"k": '||conv_id||'}}'{_N}chr(10)
  WHEN 3 THEN 'Otra solución'{_N}chr(10)||'npm install paquete-'||turn{_N}chr(10)||'Assets/plugins/file'||turn||'.json'{_N}chr(10)||'Esto es <https://example.com/x?a=1> para \\*ver\\* que **funciona **bien'{_N}chr(10)||'1. uno'{_N}'2. dos [enlace](https://example.com/y)'{_N}chr(10)
  WHEN 4 THEN '<!DOCTYPE html>'{_N}'<html>'{_N}'</html>'{_N}'let total: number = '||turn||';'{_N}chr(10)||'```{{=html}}'{_N}'<!-- -->'{_N}'```'{_N}chr(10)||'AST (Abstract Syntax Tree)'{_N}chr(10)||'x = [10, "hello"]; // Error'{_N}chr(10)
  ELSE '**Object.create**'{_N}chr(10)||'.menu {{'{_N}'color: red;'{_N}'}}'{_N}chr(10)||'> cita de '||role{_N}chr(10)||'#### Nota final'{_N}chr(10) END
"""


def conversation_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): a document per conversation."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").selectExpr("conv_id as doc_id", "turn", PIECE.replace("chr(10)", "char(10)").replace("\\*", "\\\\*") + " as piece")
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("turn", "piece"))), lambda x: x["piece"])
    return turns.groupBy("doc_id").agg(F.array_join(pieces, "").alias("text"))


#: The same documents for DuckDB.
CORPUS_SQL = f"corpus AS (SELECT conv_id AS doc_id, string_agg(piece, '' ORDER BY turn) AS text FROM (SELECT conv_id, turn, {PIECE} AS piece FROM conversations) GROUP BY conv_id)"
