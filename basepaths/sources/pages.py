"""Data embedded in web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basepaths.functions.identity import person_key
from basepaths.functions.text import innings_to_decimal

# fixed values: how the pages embed their data
CHUNK = r'self\.__next_f\.push\(\[1,"((?:\\.|[^"\\])*)"\]\)'


def embedded_text(html: Column) -> Column:
    """All pushed string chunks, unescaped and joined."""
    chunks = F.regexp_extract_all(html, F.lit(CHUNK), F.lit(1))
    plain = F.transform(chunks, lambda c: F.get_json_object(F.concat(F.lit('{"x":"'), c, F.lit('"}')), "$.x"))
    return F.concat_ws("", plain)


def embedded_object(pages: DataFrame, key: str, schema: str, html: str = "html", output: str = "data") -> DataFrame:
    """The object that follows ``key`` in every page; a page without it fails the job.

    The text from the first brace behind the key is parsed; the JSON reader stops at the end
    of the first complete object.
    """
    text = embedded_text(F.col(html))
    rows = pages.withColumn("_text", text)
    at = F.position(F.lit(f'"{key}"'), F.col("_text"))
    tail = F.substring(F.col("_text"), at, F.length("_text"))
    body = F.substring(tail, F.position(F.lit("{"), tail), F.length(tail))
    parsed = F.from_json(F.when(at > 0, body), schema)
    checked = F.when(F.col(output).isNull(), F.raise_error(F.lit(f"page does not contain {key}")).cast(schema)).otherwise(F.col(output))
    return rows.withColumn(output, parsed).withColumn(output, checked).drop("_text")


# fixed values: pitching line in the escaped page text
PITCHING_LINE = (
    r'\{\\"personId\\":\d+,\\"eventTeamId\\":\d+,\\"displayName\\":\\"([^"\\]+)\\"[^{}]*?\\"position\\":\\"P\\"[^{}]*?\\"h\\":(\d+),\\"r\\":(\d+),'
    r'\\"er\\":(\d+),\\"bb\\":(\d+),\\"so\\":(\d+),\\"hr\\":(\d+),\\"ab\\":(\d+),\\"bf\\":(\d+),\\"np\\":(\d+)[^{}]*?\\"ip\\":\\"([0-9.]+)\\"'
)
LINE_FIELDS = ("player", "H", "R", "ER", "BB", "SO", "HR", "AB", "BF", "Pitches", "innings")


def pitching_lines(pages: DataFrame, html: str = "html") -> DataFrame:
    """(player, game) pitching lines found by one pattern over the escaped page."""
    groups = [F.regexp_extract_all(F.col(html), F.lit(PITCHING_LINE), F.lit(n + 1)).alias(name) for n, name in enumerate(LINE_FIELDS)]
    rows = pages.select("canonical_id", F.explode(F.arrays_zip(*groups)).alias("line")).select("canonical_id", "line.*")
    numbers = {name: F.col(name).cast("int") for name in LINE_FIELDS[1:-1]}
    return rows.withColumns(numbers).withColumns({
        "player_key": person_key(F.col("player")), "innings_decimal": innings_to_decimal(F.col("innings")),
    }).drop("innings")
