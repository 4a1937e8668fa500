"""Wiki templates and markup as column expressions: spans, parameters, rendering, clean-up, issues.

A page is rendered within its row, without a shuffle: braces are folded into spans, each span into a
name and ordered parameters, and these by a table of rules into text that takes the span's place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query, read

# Bracket tokens of an older format and their labels.
LEGACY = [
    (r"\[DiarySkillStats: *([^\]]*)\]", "Skill requirements: $1"),
    (r"\[ItemSpawnTableHead: *([^\]]*)\]", "Item spawns: $1"),
    (r"\[ItemSpawnLine: *([^\]]*)\]", "Spawn: $1"),
]


def apply_rules(t: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, new in rules:
        t = F.regexp_replace(t, pattern, new)
    return F.trim(t)


def spans(t: Column) -> Column:
    """The outermost templates of a text, in order, as (start, end) from 0; unclosed braces do not count."""
    span = "struct<s:int,e:int>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("stack"), F.array().cast(f"array<{span}>").alias("found"))

    def step(acc: Column, c: Column) -> Column:
        depth = F.size(acc["stack"])
        close = (c == "}}") & (depth > 0)
        top = F.element_at(acc["stack"], F.greatest(depth, F.lit(1)))
        end = acc["at"] + F.char_length(c)
        stack = F.when(c == "{{", F.concat(acc["stack"], F.array(acc["at"]))).when(close, F.slice(acc["stack"], 1, F.greatest(depth - 1, F.lit(0)))).otherwise(acc["stack"])
        found = F.when(close, F.concat(F.filter(acc["found"], lambda x: x["s"] < top), F.array(F.struct(top.alias("s"), end.alias("e"))))).otherwise(acc["found"])
        return F.struct(end.alias("at"), stack.alias("stack"), found.alias("found"))

    pieces = F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(r"\{\{|\}\}|[^{}]+|[{}]"), F.lit(0))
    # element_at of an empty stack is never used, but must not fail
    return F.aggregate(pieces, zero, step, lambda acc: acc["found"])


def parts(inner: Column) -> Column:
    """The inner text of a template at its bars, those within braces left alone."""
    zero = F.struct(F.lit(0).alias("depth"), F.lit("").alias("cur"), F.array().cast("array<string>").alias("done"))

    def step(acc: Column, c: Column) -> Column:
        cut = (c == "|") & (acc["depth"] == 0)
        depth = acc["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        return F.struct(depth.alias("depth"), F.when(cut, "").otherwise(F.concat(acc["cur"], c)).alias("cur"), F.when(cut, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]).alias("done"))

    # a trailing empty part is dropped
    end = lambda a: F.when(a["cur"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["cur"])))
    return F.aggregate(F.regexp_extract_all(inner, F.lit(r"[{}|]|[^{}|]+"), F.lit(0)), zero, step, end)


def _clip(t: Column) -> Column:
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def params(ps: Column) -> Column:
    """Parts as (key, value); one without a key is counted: "1", "2" and so on."""
    zero = F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<key:string,value:string>>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        named = F.contains(p, F.lit("="))
        n = acc["n"] + F.when(named, 0).otherwise(1)
        key = F.when(named, _clip(F.substring_index(p, "=", 1))).otherwise(n.cast("string"))
        value = F.when(named, _clip(F.regexp_replace(p, "^[^=]*=", ""))).otherwise(_clip(p))
        return F.struct(n.alias("n"), F.concat(acc["out"], F.array(F.struct(key.alias("key"), value.alias("value")))).alias("out"))

    return F.aggregate(ps, zero, step, lambda acc: acc["out"])


def templates(t: Column) -> Column:
    """The outermost templates of a text: (s, e, inner, name, params). The first bar ends the name, whatever braces are around it."""
    inner = lambda x: _clip(F.substring(t, x["s"] + 3, x["e"] - x["s"] - 4))
    a = F.transform(spans(t), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), inner(x).alias("inner")))
    name = lambda x: _clip(F.substring_index(x["inner"], "|", 1))
    rest = lambda x: parts(F.regexp_replace(x["inner"], r"^[^|]*\|?", ""))
    return F.transform(a, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["inner"].alias("inner"), name(x).alias("name"), params(rest(x)).alias("params")))


def legacy_fixed(t: Column) -> Column:
    """Bracket tokens of the older format as labelled text."""
    return apply_rules(t, LEGACY)


# Labels that a page has whose templates were parsed.
PARSED = ["Combat Level:", "Attack:", "Defence:", "Drop:", "Rarity:", "Location:", "Area:"]


def issues(text: Column, raw: Column) -> Column:
    """Codes of what is wrong with a page. Templates count as unparsed if there are over five and no label of parsed ones."""
    many = F.regexp_count(text, F.lit(r"\{\{[^}]+\}\}")) > 5
    for label in PARSED:
        many &= ~F.contains(text, F.lit(label))
    return F.array_compact(
        F.array(
            F.when(text.rlike(r"\[(DiarySkillStats|ItemSpawnTableHead|ItemSpawnLine):"), F.lit("legacy_bracket_tokens")),
            F.when(F.coalesce(raw, F.lit("")) == "", F.lit("missing_raw_wikitext")),
            F.when(many, F.lit("unparsed_templates")),
        )
    )


def wiki(spark: SparkSession, d: str) -> DataFrame:
    """Wiki pages made of `part`: an infobox, prose, a nested template, an unknown and an unclosed one."""
    raw = "format_string('{{Infobox Item\\n|name = %s\\n|value = %d\\n|brand = [[%s|the brand]]\\n}}\\n\\'\\'\\'%s\\'\\'\\' is made by [[%s|them]] as [[%s]].\\n{{Coins|%d}} {{Chart head}} {{Odd {{Sub|%d}}}} {{open', p_name, p_size, p_brand, p_name, p_brand, p_type, p_size, p_size)"
    return read(spark, d, "part").selectExpr("p_partkey", "p_name", "p_brand", "p_type", "p_size", f"{raw} as raw")


#: Old tokens after the name of a part; parts with an even size have them.
_OLD_SQL = "p_name || CASE WHEN p_size % 2 = 0 THEN ' [DiarySkillStats: ' || p_brand || '] [ItemSpawnLine: ' || p_type || ']' ELSE '' END"


def _sql_rules(t: str, rules: list[tuple[str, str]]) -> str:
    for pattern, new in rules:
        p, n = pattern.replace("'", "''"), new.replace("$", "\\")
        t = f"regexp_replace({t}, '{p}', '{n}', 'g')"
    return f"trim({t})"


_SPANS = """WITH t AS (SELECT p_partkey, p_name, p_size, p_brand, '{{Infobox Item' || chr(10) || '|name = ' || p_name || chr(10) || '|value = ' || p_size || chr(10) || '|brand = [[' || p_brand || '|the brand]]' || chr(10) || '}}' AS box,
    chr(10) || '''''''' || p_name || ''''''' is made by [[' || p_brand || '|them]] as [[' || p_type || ']].' || chr(10) AS prose, '{{Coins|' || p_size || '}}' AS coins, '{{Odd {{Sub|' || p_size || '}}}}' AS odd, p_type FROM part)"""


@query("template_spans", _SPANS + """ SELECT p_partkey, unnest([0, 1, 2, 3])::INTEGER AS pos, unnest([0, length(box || prose), length(box || prose || coins) + 1, length(box || prose || coins) + 16])::INTEGER AS start, unnest([box, coins, '{{Chart head}}', odd]) AS template FROM t""")
def template_spans(spark: SparkSession, d: str) -> DataFrame:
    w = wiki(spark, d).select("p_partkey", "raw", F.posexplode(spans(F.col("raw"))).alias("pos", "x"))
    return w.select("p_partkey", "pos", F.col("x.s").alias("start"), F.expr("substring(raw, x.s + 1, x.e - x.s)").alias("template"))


@query("template_params", _SPANS + """, r AS (SELECT p_partkey, unnest([0, 0, 0, 0, 1, 3]) AS pos, unnest([0, 1, 2, 3, 0, 0]) AS param_pos, unnest(['name', 'value', 'brand', '1', '1', '1']) AS key, unnest([p_name, p_size::VARCHAR, '[[' || p_brand, 'the brand]]', p_size::VARCHAR, p_size || '}}']) AS value FROM t) SELECT p_partkey, pos::INTEGER AS pos, param_pos::INTEGER AS param_pos, key, value FROM r""")
def template_params(spark: SparkSession, d: str) -> DataFrame:
    """The bar of a link cuts a parameter as well; only braces protect one."""
    w = wiki(spark, d).select("p_partkey", F.posexplode(templates(F.col("raw"))).alias("pos", "x"))
    return w.select("p_partkey", "pos", F.posexplode("x.params").alias("param_pos", "p")).select("p_partkey", "pos", "param_pos", "p.key", "p.value")


@query("legacy_token_fix", "SELECT p_partkey, p_name || CASE WHEN p_size % 2 = 0 THEN ' Skill requirements: ' || p_brand || ' Spawn: ' || p_type ELSE '' END AS text FROM part")
def legacy_token_fix(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", legacy_fixed(F.expr(_OLD_SQL)).alias("text"))


@query("infobox_links", "SELECT p_partkey, unnest([split_part(p_brand, '#', 1), split_part(p_brand, '#', 1), p_type]) AS target, unnest([0, 1, 2])::INTEGER AS pos FROM part")
def infobox_links(spark: SparkSession, d: str) -> DataFrame:
    """Targets of internal links, up to the section or bar; a target with a colon does not count."""
    links = F.regexp_extract_all("raw", F.lit(r"\[\[([^\]|:#]+)([#|][^\]]*)?\]\]"), F.lit(1))
    return wiki(spark, d).select("p_partkey", F.posexplode(links).alias("pos", "target"))


def infobox(raw: Column) -> Column:
    """Keys and values of the first infobox, a line each, in order: keys lowered and with underscores, values without
    the braces of links and templates."""
    body = F.regexp_extract(raw, r"(?s)\{\{Infobox[^\n]*\n(.*?)\n\}\}", 1)
    key = lambda x: F.regexp_replace(F.lower(F.regexp_extract(x, r"^\| *([^=]*?) *=", 1)), " +", "_")
    bare = lambda x: _clip(F.regexp_replace(F.regexp_replace(x, r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "$1"), r"\{\{|\}\}", ""))
    pairs = F.transform(F.split(body, "\n"), lambda x: F.struct(key(x).alias("key"), bare(F.regexp_extract(x, r"^[^=]*= *(.*?) *$", 1)).alias("value")))
    return F.filter(pairs, lambda x: x["key"] != "")


_BOXED = "regexp_replace(raw, 'name = ', 'Item Name = {{')"


@query("infobox_values", "SELECT p_partkey, unnest(['item_name', 'value', 'brand']) AS key, unnest([p_name, p_size::VARCHAR, 'the brand']) AS value FROM part")
def infobox_values(spark: SparkSession, d: str) -> DataFrame:
    """The last of a repeated key wins."""
    w = wiki(spark, d).select("p_partkey", F.posexplode(infobox(F.expr(_BOXED))).alias("pos", "x"))
    return w.groupBy("p_partkey", F.col("x.key").alias("key")).agg(F.max_by("x.value", "pos").alias("value"))


@query("infobox_triples", "SELECT 'Part ' || p_partkey AS head, unnest(['has_name', 'has_value', 'has_brand']) AS relation, unnest([p_name, p_size::VARCHAR, 'the brand']) AS tail, 'Part ' || p_partkey AS source_title, p_partkey::BIGINT AS revid FROM part")
def infobox_triples(spark: SparkSession, d: str) -> DataFrame:
    """A triple has_<key> for each value of a page's infobox."""
    w = wiki(spark, d).select("p_partkey", F.posexplode(infobox(F.col("raw"))).alias("pos", "x"))
    last = w.groupBy("p_partkey", F.col("x.key").alias("key")).agg(F.max_by("x.value", "pos").alias("tail"))
    title = F.concat(F.lit("Part "), F.col("p_partkey").cast("string"))
    return last.select(title.alias("head"), F.concat(F.lit("has_"), "key").alias("relation"), "tail", title.alias("source_title"), F.col("p_partkey").cast("long").alias("revid"))
