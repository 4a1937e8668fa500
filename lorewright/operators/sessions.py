"""What a conversation knows by number: facts like `the 3rd brother is ...`, and questions that refer to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..registry import query, read

# Number words, the order of the brothers, and the forms of a statement (number, name), first match counts.
NUMBERS = {"first": "1", "second": "2", "third": "3", "fourth": "4", "fifth": "5", "sixth": "6"}
BROTHERS = {"ahrim": "1", "dharok": "2", "guthan": "3", "karil": "4", "torag": "5", "verac": "6"}
_NTH, _WORD, _NAME = r"(\d+)(?:st|nd|rd|th)\s+", rf"({'|'.join(NUMBERS)})\s+", r"([A-Z][a-z]+(?:\s+the\s+[A-Z][a-z]+)?)"
STATED = [
    rf"(?i){_NTH}barrows\s+brother.*?is\s+{_NAME}",
    rf"(?i){_NTH}brother\s+is\s+([A-Z][a-z]+(?:\s+(?:the\s+)?[A-Z][a-z]+)?)",
    rf"(?i)the\s+{_WORD}barrows\s+brother\s+is\s+{_NAME}",
    rf"(?i){_WORD}brother\s+is\s+{_NAME}",
]
EPITHET = r"(?i)([A-Z][a-z]+)\s+\(the\s+([A-Z][a-z]+)\)"
#: Forms of a reference; the second counts only where there is no first.
ASKED = [r"(?i)(?:the\s+)?(\d+)(?:st|nd|rd|th)\s+barrows\s+brother", r"(?i)(?:the\s+)?(\d+)(?:st|nd|rd|th)\s+brother"]


def _looked_up(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.lower(key))


def stated(text: Column) -> Column:
    """struct(ordinal, name) of the first form of statement that a text has; null without any."""
    found = lambda p, g: F.regexp_extract(text, p, g)
    fact = lambda number, name: F.struct(number.alias("ordinal"), name.alias("name"))
    forms = [F.when(found(p, 1) != "", fact(F.coalesce(_looked_up(NUMBERS, found(p, 1)), found(p, 1)), found(p, 2))) for p in STATED]
    number = _looked_up(BROTHERS, found(EPITHET, 1))
    return F.coalesce(*forms, F.when(number.isNotNull(), fact(number, F.concat_ws(" the ", found(EPITHET, 1), found(EPITHET, 2)))))


def ordinals(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, ordinal, name): what each turn states."""
    return turns.select("conv_id", "turn", stated(F.col("text")).alias("fact")).filter("fact is not null").select("conv_id", "turn", "fact.*")


def resolved(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, resolved): references by number replaced by the name that a turn before stated last."""
    text = F.col("text")
    first, second = (F.regexp_extract("text", p, 1) for p in ASKED)
    asks = turns.select("conv_id", "turn", "text", F.when(first != "", 0).when(second != "", 1).alias("form"), F.coalesce(F.nullif(first, F.lit("")), F.nullif(second, F.lit(""))).alias("ordinal"))
    facts = ordinals(turns).select("conv_id", "turn", F.lit(None).cast("string").alias("text"), F.lit(None).cast("int").alias("form"), "ordinal", "name")
    # a turn's question comes before what the turn states
    so_far = W.partitionBy("conv_id", "ordinal").orderBy("turn", F.col("name").isNotNull()).rowsBetween(W.unboundedPreceding, -1)
    both = asks.filter("form is not null").withColumn("name", F.lit(None).cast("string")).unionByName(facts)
    asked = both.withColumn("known", F.last("name", ignorenulls=True).over(so_far)).filter("form is not null")
    named = F.when(F.col("form") == 0, F.regexp_replace(text, F.lit(ASKED[0]), F.col("known"))).otherwise(F.regexp_replace(text, F.lit(ASKED[1]), F.col("known")))
    out = asked.select("conv_id", "turn", F.coalesce(named, text).alias("resolved"))
    return out.unionByName(asks.filter("form is null").select("conv_id", "turn", text.alias("resolved")))


#: Conversations that state and ask, by the turn and the conversation.
_SAID = """CASE turn % 2 WHEN 0 THEN CASE conv_id % 3 WHEN 0 THEN 'What does the 3rd Barrows brother wear? ' WHEN 1 THEN 'And the 2nd brother, or the 1st? ' ELSE 'Where is the 5th brother? ' END
    ELSE CASE conv_id % 4 WHEN 0 THEN 'The 3rd barrows brother, as told, is Guthan the Infested. ' WHEN 1 THEN 'The second brother is Dharok. ' WHEN 2 THEN 'Torag (the Corrupted) waits. ' ELSE 'The 3rd brother is Guthan. ' END END || text"""
_TALK_SQL = f"talk AS (SELECT conv_id, turn, {_SAID} AS text FROM conversations)"
_MAP_SQL = lambda table: "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in table.items()) + "}"
_FACTS_SQL = f"""{_TALK_SQL}, form AS (SELECT *, {", ".join(f"regexp_extract(text, '{p}', 1) AS n{k}, regexp_extract(text, '{p}', 2) AS m{k}" for k, p in enumerate([*STATED, EPITHET]))} FROM talk),
  facts AS (SELECT conv_id, turn, CASE {" ".join(f"WHEN n{k} <> '' THEN coalesce({_MAP_SQL(NUMBERS)}[lower(n{k})], n{k})" for k in range(len(STATED)))} ELSE {_MAP_SQL(BROTHERS)}[lower(n{len(STATED)})] END AS ordinal,
    CASE {" ".join(f"WHEN n{k} <> '' THEN m{k}" for k in range(len(STATED)))} ELSE n{len(STATED)} || ' the ' || m{len(STATED)} END AS name FROM form)"""


def _talk(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").select("conv_id", "turn", F.expr(_SAID).alias("text"))


@query("turn_ordinals", f"WITH {_FACTS_SQL} SELECT * FROM facts WHERE ordinal IS NOT NULL")
def turn_ordinals(spark: SparkSession, d: str) -> DataFrame:
    return ordinals(_talk(spark, d))


@query(
    "resolve_ordinals",
    f"""WITH {_FACTS_SQL}, asks AS (SELECT *, regexp_extract(text, '{ASKED[0]}', 1) AS a, regexp_extract(text, '{ASKED[1]}', 1) AS b FROM talk),
    k AS (SELECT q.conv_id, q.turn, q.text, q.a, (SELECT arg_max(f.name, f.turn) FROM facts f WHERE f.conv_id = q.conv_id AND f.turn < q.turn AND f.ordinal = CASE WHEN q.a <> '' THEN q.a ELSE q.b END) AS known FROM asks q)
    SELECT conv_id, turn, CASE WHEN known IS NULL THEN text WHEN a <> '' THEN regexp_replace(text, '{ASKED[0]}', known, 'g') ELSE regexp_replace(text, '{ASKED[1]}', known, 'g') END AS resolved FROM k""",
)
def resolve_ordinals(spark: SparkSession, d: str) -> DataFrame:
    return resolved(_talk(spark, d))
