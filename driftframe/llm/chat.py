"""Chat formatting by Spark expressions only.

Turns are collected as structs, sorted, merged where neighbours have the same role (array aggregation) and
concatenated.  A conversation is collected in two steps, first by blocks of 64 turns: a conversation with a
great share of all turns reaches its one row as a few formatted blocks, not as turns.  Every step takes time in
proportion to a conversation's length.

Template, for each run of turns of one role: ``<|turn|>`` role ``<|text|>`` text ``<|next|>`` text ... ``<|end|>``.
Inside roles and texts a backslash is doubled and ``<|`` becomes ``<\\|``; this is undone exactly.

Null roles and texts are empty; a null turn comes first; turns with one number are ordered by role, then text;
rows with a null conv_id form one conversation; repeated rows are repeated turns; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The template's control strings.
TURN, TEXT, NEXT, STOP = "<|turn|>", "<|text|>", "<|next|>", "<|end|>"
LEARNED = "assistant"
BLOCK = 64


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def cut(text: Column, mark: str) -> Column:
    return F.split(text, "\\Q" + mark + "\\E")


def joined(parts: Column) -> Column:
    """Joins structs (first role, last role, body) into one: a run goes on where roles meet, else a new one begins.

    Each body is copied once."""

    def piece(part: Column, i: Column) -> Column:
        before = F.get(parts, i - 1)["last"]
        return F.when(i == 0, part["body"]).when(before == part["first"], F.concat(F.lit(NEXT), part["body"])).otherwise(F.concat(F.lit(STOP + TURN), part["first"], F.lit(TEXT), part["body"]))

    return F.struct(F.element_at(parts, 1)["first"].alias("first"), F.element_at(parts, -1)["last"].alias("last"), F.array_join(F.transform(parts, piece), "").alias("body"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted: one row for each conversation."""
    rows = turns.select("conv_id", "turn", escape(F.coalesce("role", F.lit(""))).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("text"))
    blocks = rows.groupBy("conv_id", F.floor(F.col("turn") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    blocks = blocks.select("conv_id", "block", F.transform("turns", lambda t: F.struct(t["role"].alias("first"), t["role"].alias("last"), t["text"].alias("body"))).alias("parts"))
    blocks = blocks.select("conv_id", "block", joined(F.col("parts")).alias("run"))
    whole = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "run"))).alias("blocks"))
    whole = whole.select("conv_id", F.transform("blocks", lambda b: b["run"]).alias("parts"))
    whole = whole.select("conv_id", joined(F.col("parts")).alias("run"))
    return whole.select("conv_id", F.concat(F.lit(TURN), F.col("run.first"), F.lit(TEXT), F.col("run.body"), F.lit(STOP)).alias("formatted"))


def runs_of(formatted: Column) -> Column:
    """Array of (role, texts), both as written: the formatted string is split at its marks, each once."""
    runs = F.filter(cut(formatted, STOP), lambda run: run != "")
    sides = F.transform(runs, lambda run: cut(F.substr(run, F.lit(len(TURN) + 1)), TEXT))
    return F.transform(sides, lambda side: F.struct(side[0].alias("role"), cut(side[1], NEXT).alias("texts")))


def turns_of(runs: Column) -> Column:
    """Array of (role, text), unescaped, of the runs read back."""
    named = F.transform(runs, lambda run: F.struct(unescape(run["role"]).alias("role"), run["texts"].alias("texts")))
    return F.flatten(F.transform(named, lambda run: F.transform(run["texts"], lambda text: F.struct(run["role"].alias("role"), unescape(text).alias("text")))))


#: Entries that are added up at once for offsets.
RADIX = 64


def total(array: Column, first: Column, n: Column | int) -> Column:
    return F.aggregate(F.slice(array, first, n), F.lit(0).cast("long"), lambda a, x: a + x)


def block_sums(array: Column) -> Column:
    """The sums of every RADIX entries."""
    blocks = F.ceil(F.size(array) / F.lit(RADIX)).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(blocks, F.lit(1)) - 1), lambda b: total(array, b * RADIX + 1, RADIX))


def before_each(lengths: Column, sums: list[Column]) -> Column:
    """The sum of the entries before each entry, from the block sums of each level: some RADIX additions a level."""

    def before(_: Column, i: Column) -> Column:
        out = F.lit(0).cast("long")
        for level, array in enumerate([lengths, *sums]):
            place = F.floor(i / F.lit(RADIX**level)).cast("int")
            first = place - place % RADIX if level < len(sums) else F.lit(0)
            out = out + total(array, first + 1, place - first)
        return out

    return F.transform(lengths, before)


def loss_spans(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, __spans: (start from 0, length) of the code points of the formatted string that are learned."""
    rows = formatted.select("conv_id", "formatted", runs_of(F.col("formatted")).alias("__runs"))
    head = len(TURN) + len(TEXT)
    pieces = F.flatten(
        F.transform(
            "__runs",
            lambda run: F.transform(
                run["texts"],
                lambda text, i: F.struct(
                    F.when(i == 0, F.length(run["role"]) + head).otherwise(len(NEXT)).cast("long").alias("before"),
                    F.length(text).cast("long").alias("length"),
                    (unescape(run["role"]) == LEARNED).alias("learned"),
                    F.when(i == F.size(run["texts"]) - 1, len(STOP)).otherwise(0).cast("long").alias("after"),
                ),
            ),
        )
    )
    rows = rows.select("conv_id", "formatted", pieces.alias("__pieces"))
    rows = rows.withColumn("__lengths", F.transform("__pieces", lambda p: p["before"] + p["length"] + p["after"]))
    for level in range(1, 4):  # a column for each level, so that none is computed for each piece
        below = "__lengths" if level == 1 else f"__sums{level - 1}"
        rows = rows.withColumn(f"__sums{level}", block_sums(F.col(below)))
    at = before_each(F.col("__lengths"), [F.col(f"__sums{i}") for i in range(1, 4)])
    rows = rows.withColumn("__at", at)
    spans = F.filter(F.transform(F.arrays_zip("__pieces", "__at"), lambda x: F.struct((x["__at"] + x["__pieces"]["before"]).alias("start"), x["__pieces"]["length"].alias("length"), x["__pieces"]["learned"].alias("learned"))), lambda x: x["learned"])
    return rows.select("conv_id", "formatted", F.transform(spans, lambda x: F.struct(x["start"], x["length"])).alias("__spans"))


def digest(formatted: DataFrame) -> DataFrame:
    """What is read back from formatted strings: turns, and the text under the loss mask."""
    read = formatted.select("conv_id", "formatted", runs_of(F.col("formatted")).alias("__runs"))
    read = read.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), turns_of(F.col("__runs")).alias("__turns"))
    learned = F.transform(F.filter("__turns", lambda t: t["role"] == LEARNED), lambda t: t["text"])
    read = read.withColumn("__loss", F.array_join(learned, ""))
    said = F.array_join(F.transform("__turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("__turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("__loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("__loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return digest(format_conversations(turns.unionByName(more)))


#: A run of turns of one role costs its marks once, a further turn of the run <|next|>.
SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), placed AS (
  SELECT *, row_number() OVER w AS place, role IS NOT DISTINCT FROM lag(role) OVER w AND row_number() OVER w > 1 AS goes_on,
         replace(replace(role, '\', '\\'), '<|', '<\|') AS role_out, replace(replace(text, '\', '\\'), '<|', '<\|') AS text_out
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(text_out) + CASE WHEN goes_on THEN 8 ELSE 23 + length(role_out) END) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id
"""
