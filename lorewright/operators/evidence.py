"""Ranking by words and structure, expansion, sections, and evidence for answers. Questions are bounded tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..registry import query, read
from ..staging import scratch, stage
from .intents import INTENTS, in_sql, tags
from .retrieval import _COS, _E, corpus, cosine_topk

# Verdict patterns, negative ones first.
VERDICTS = [
    ("No", "immune to melee|cannot be damaged by melee|melee (?:cannot|can't|won't) (?:hit|damage|affect)|only (?:damaged|affected|harmed|hit|attacked) by (?:magic|ranged)|can only be (?:damaged|affected|harmed|hit|attacked) by (?:magic|ranged)|must use (?:magic|ranged)"),
    ("Yes", "can be damaged by melee|melee (?:can|does) (?:hit|damage|affect)|vulnerable to melee|weak to melee"),
]
# Lines that state a requirement.
REQUIRED = r"(^|[^a-z])requires? (.{0,99}[^a-z])?(level|lvl|quest|skill|completion)([^a-z]|$)|(^|[^a-z])to (wear|equip) (.{0,79}[^a-z])?(level|lvl)([^a-z]|$)|(^|[^a-z])requirements? *: *"
#: Terms that an intent adds to a question.
NEUTRAL = {"location": "where to find", "stats": "statistics", "requirements": "prerequisites", "timeline": "release date"}


# The boosts and priors of the next two functions, and the lengths and headings that they ask for.
def lexical_boost(title: Column, q: Column) -> Column:
    """Title equal to the question, within it, or holding it; else any of its words longer than three characters."""
    word = F.exists(tokens(q), lambda w: (F.char_length(w) > 3) & F.contains(title, w))
    return F.when(title == q, 0.40).when(F.contains(q, title), 0.25).when(F.contains(title, q), 0.15).when(word, 0.15).otherwise(0.0)


def structure(text: Column, title: Column) -> Column:
    """Priors by form: short and long texts, headings, variants and namespaces of titles, kept within -1 and 1."""
    n = F.char_length(text)
    score = F.when(n < 400, -0.08).when(n > 3000, 0.02).otherwise(0.0) + F.when(F.regexp_count(text, F.lit(r"(?m)^=+")) >= 3, 0.03).otherwise(0.0)
    score = score + F.when(title.rlike(r"\("), -0.06).otherwise(0.0) + F.when(title.rlike("^[a-z]+:"), -0.12).otherwise(0.0)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score))


def _titles(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("title")).distinct()


def _pieces(text: Column, sizes: tuple[int, ...] = (1, 2, 3, 4)) -> Column:
    """The distinct substrings of these sizes."""
    n = F.char_length(text)
    part = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(text, i, F.lit(k)))).otherwise(F.array())
    return F.array_distinct(F.flatten(F.array(*(part(k) for k in sizes))))


def _within(whole: DataFrame, inner: DataFrame) -> DataFrame:
    """(x, y): texts y of inner that may be a substring of texts x of whole, all that are among them.

    A text's first four characters (all, if it is shorter) are among the pieces of every text that holds it: an equality
    to join on, in place of all pairs.
    """
    return whole.select("x", F.explode(_pieces(F.col("x"))).alias("piece")).join(inner.select("y", F.substring("y", 1, 4).alias("piece")), "piece").select("x", "y")


_BOOST = """t AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS title FROM part), q AS (SELECT item_id, lower(text) AS q FROM benchmark),
s AS (SELECT item_id, title, CASE WHEN title = q THEN 0.4 WHEN contains(q, title) THEN 0.25 WHEN contains(title, q) THEN 0.15 WHEN len(list_filter(regexp_split_to_array(q, '[^a-z0-9]+'), lambda w: length(w) > 3 AND contains(title, w))) > 0 THEN 0.15 ELSE 0 END::DOUBLE AS boost FROM t, q)"""


@query("lexical_boost", f"WITH {_BOOST} SELECT * FROM s WHERE boost > 0")
def lexical_boosts(spark: SparkSession, d: str) -> DataFrame:
    """Titles with a boost for a question. Who may hold whom is found by joins on pieces of texts, never all pairs;
    an empty text is held by none."""
    asked = read(spark, d, "benchmark").select("item_id", F.lower("text").alias("q"))
    titles, q = _titles(spark, d), asked.select("q").distinct()
    word = q.select("q", F.explode(F.array_distinct(tokens(F.col("q")))).alias("w")).filter(F.char_length("w") > 3)
    named = _within(titles.select(F.col("title").alias("x")), word.select(F.col("w").alias("y")).distinct())
    found = named.join(word, F.col("y") == F.col("w")).select("q", F.col("x").alias("title"))
    found = found.unionByName(_within(q.select(F.col("q").alias("x")), titles.select(F.col("title").alias("y"))).select(F.col("x").alias("q"), F.col("y").alias("title")))
    found = found.unionByName(_within(titles.select(F.col("title").alias("x")), q.select(F.col("q").alias("y"))).select(F.col("y").alias("q"), F.col("x").alias("title")))
    scored = found.distinct().withColumn("boost", lexical_boost(F.col("title"), F.col("q"))).filter("boost > 0")
    return asked.join(scored, "q").select("item_id", "title", "boost")


# Words of questions about quick ways, what intents add to a question, and what is asked of titles.
QUICK = "bulk|burst|barrage|chinning|efficient|fast"
FOLLOW = {"strategy": ["strategy", "best method", "efficient setup"], "location": ["locations", "where to find", "catacombs dungeon cave"]}
OF_TITLE = ["strategy", "location", "drops"]


def follow_ups(q: Column, titles: Column, most: int = 8) -> Column:
    """The question, what its intents add to it, and what is asked of the first three titles; each once, at most so many."""
    kinds = {"strategy": F.lower(q).rlike(f"{INTENTS['strategy']}|{QUICK}"), "location": F.lower(q).rlike(INTENTS["location"])}
    more = [F.when(on, F.array(*(F.concat_ws(" ", q, F.lit(x)) for x in FOLLOW[k]))).otherwise(F.array().cast("array<string>")) for k, on in kinds.items()]
    named = F.flatten(F.transform(F.slice(titles, 1, 3), lambda t: F.array(*(F.concat_ws(" ", t, F.lit(x)) for x in OF_TITLE))))
    return F.slice(F.array_distinct(F.filter(F.concat(F.array(q), *more, named), lambda x: x != "")), 1, most)


_FOLLOW_SQL = ", ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN [{', '.join(f"text || ' {x}'" for x in FOLLOW[k])}] ELSE [] END" for k, p in (("strategy", f"{INTENTS['strategy']}|{QUICK}"), ("location", INTENTS["location"])))


@query(
    "subquery_titles",
    f"""WITH {_BOOST}, r AS (SELECT item_id, title, row_number() OVER (PARTITION BY item_id ORDER BY boost DESC, title) AS n FROM s WHERE boost > 0),
    w AS (SELECT item_id, list(title ORDER BY n) AS titles FROM r WHERE n <= 3 GROUP BY item_id),
    e AS (SELECT item_id, flatten([[text], {_FOLLOW_SQL}, coalesce(flatten(list_transform(titles, lambda t: [{', '.join(f"t || ' {x}'" for x in OF_TITLE)}])), [])]) AS qs FROM benchmark LEFT JOIN w USING (item_id)),
    u AS (SELECT item_id, unnest(qs) AS q, unnest(range(len(qs))) AS pos FROM e), f AS (SELECT item_id, q, min(pos) AS pos FROM u WHERE q <> '' GROUP BY ALL)
    SELECT item_id, q, row_number() OVER (PARTITION BY item_id ORDER BY pos) AS n FROM f QUALIFY n <= 8""",
)
def subquery_titles(spark: SparkSession, d: str) -> DataFrame:
    """Follow-up questions, seeded with the titles that fit a question best."""
    rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.col("boost").desc(), "title"))
    best = lexical_boosts(spark, d).withColumn("n", rank).filter("n <= 3").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("n", "title"))).alias("all"))
    q = read(spark, d, "benchmark").select("item_id", "text").join(best, "item_id", "left")
    titles = F.coalesce(F.transform("all", lambda x: x["title"]), F.array().cast("array<string>"))
    return q.select("item_id", F.posexplode(follow_ups(F.col("text"), titles)).alias("n", "q")).select("item_id", "q", (F.col("n") + 1).cast("long").alias("n"))


_PRIOR = "round(CASE WHEN length(text) < 400 THEN -0.08 WHEN length(text) > 3000 THEN 0.02 ELSE 0 END + CASE WHEN len(regexp_extract_all(text, '(?m)^=+')) >= 3 THEN 0.03 ELSE 0 END + CASE WHEN contains(source, '(') THEN -0.06 ELSE 0 END + CASE WHEN regexp_matches(source, '^[a-z]+:') THEN -0.12 ELSE 0 END, 9)::DOUBLE"


@query("boosted_rank", f"SELECT doc_id, source, {_PRIOR} AS prior, row_number() OVER (PARTITION BY source ORDER BY {_PRIOR} DESC, doc_id) AS rank FROM documents QUALIFY rank <= 5")
def boosted_rank(spark: SparkSession, d: str) -> DataFrame:
    prior = F.round(structure(F.col("text"), F.col("source")), 9)
    t = read(spark, d, "documents").select("doc_id", "source", prior.alias("prior"))
    return t.withColumn("rank", F.row_number().over(W.partitionBy("source").orderBy(F.col("prior").desc(), "doc_id"))).filter("rank <= 5")


@query(
    "recursive_expand",
    f"""WITH {_E}, p AS (SELECT a.vec_id AS src, b.vec_id AS dst, {_COS} AS s FROM e a JOIN e b ON a.vec_id <> b.vec_id),
    r1 AS (SELECT src AS seed, dst FROM p WHERE src % 100 = 0 QUALIFY row_number() OVER (PARTITION BY src ORDER BY s DESC, dst) <= 3),
    k AS (SELECT src, dst FROM p WHERE src IN (SELECT dst FROM r1) QUALIFY row_number() OVER (PARTITION BY src ORDER BY s DESC, dst) <= 3),
    r2 AS (SELECT DISTINCT r1.seed, k.dst FROM r1 JOIN k ON k.src = r1.dst WHERE k.dst <> r1.seed AND (r1.seed, k.dst) NOT IN (SELECT (seed, dst) FROM r1))
    SELECT seed, dst AS vec_id, 1 AS round FROM r1 UNION ALL SELECT seed, dst, 2 FROM r2""",
)
def recursive_expand(spark: SparkSession, d: str) -> DataFrame:
    """From each seed (ids divisible by 100) its nearest vectors, then those of the new ones."""
    rows = corpus(spark, d)
    with scratch(spark) as keep:
        return keep(expanded(rows, rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("seed"))).select("seed", "vec_id", "round"))


def expanded(rows: DataFrame, seeds: DataFrame, rounds: int = 2, per_seed: int = 3, most: int = 40, frontier: int = 12) -> DataFrame:
    """(seed, vec_id, round, at): round by round the nearest rows (vec_id, v) of those that the round before found first.

    In a round a seed's new rows are taken in the order of what they are near to and then of nearness, and numbered (at);
    it goes on with the first `frontier` of them and has `most` in all. What a round finds is stored, so none is
    computed again; a round of a seed has at most frontier * per_seed rows.
    """
    front = stage(seeds.select("seed", F.col("seed").alias("vec_id"), F.lit(0).alias("round"), F.lit(0).alias("at")).distinct(), "seen")
    seen = front
    for n in range(1, rounds + 1):
        q = rows.join(front.select("vec_id").distinct(), "vec_id").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
        near = cosine_topk(q, rows, per_seed, exclude_self=True).select(F.col("query_id").alias("vec_id"), F.col("vec_id").alias("to"), "rank")
        reached = front.join(near, "vec_id").groupBy("seed", F.col("to").alias("vec_id")).agg(F.min(F.struct("at", "rank")).alias("o"))
        new = reached.join(seen.select("seed", "vec_id"), ["seed", "vec_id"], "left_anti").join(seen.groupBy("seed").agg((F.count("*") - 1).alias("held")), "seed")
        new = new.withColumn("at", F.row_number().over(W.partitionBy("seed").orderBy("o", "vec_id"))).filter(F.col("at") + F.col("held") <= most)
        new = stage(new.select("seed", "vec_id", F.lit(n).alias("round"), "at"), "found")
        if new.isEmpty():
            break
        seen, front = seen.unionByName(new), new.filter(F.col("at") <= frontier)
    return seen.filter("round > 0")


_NEWS = "'Update: patch ' || lang || ' of ' || doc_id % 9 || '.\n' || text || '\nrelease:  part ' || doc_id % 5"


@query(
    "expansion_seeds",
    "WITH t AS (SELECT source, " + _NEWS.replace("\\n", "' || chr(10) || '") + r""" AS x FROM documents WHERE text IS NOT NULL)
    SELECT DISTINCT source, trim(seed) AS seed FROM (SELECT source, split_part(source || ' (x)', '(', 1) AS seed FROM t UNION ALL SELECT source, unnest(regexp_extract_all(x, '(?i)(?:update|release): *([^.\n]+)', 1)) FROM t) WHERE length(trim(seed)) BETWEEN 3 AND 120""",
)
def expansion_seeds(spark: SparkSession, d: str) -> DataFrame:
    """The title up to its parenthesis, and what the update and release lines of its texts name."""
    named = F.regexp_extract_all(F.expr(_NEWS), F.lit(r"(?i)(?:update|release): *([^.\n]+)"), F.lit(1))
    seeds = F.concat(F.array(F.substring_index(F.concat("source", F.lit(" (x)")), "(", 1)), named)
    t = read(spark, d, "documents").filter("text is not null").select("source", F.explode(F.transform(seeds, lambda s: F.trim(s))).alias("seed"))
    return t.filter(F.char_length("seed").between(3, 120)).distinct()


def section(text: Column, words: str) -> Column:
    """Lines from a heading that holds a word to the next heading that holds none."""
    zero = F.struct(F.lit(False).alias("on"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, line: Column) -> Column:
        head = F.startswith(line, F.lit("="))
        on = F.when(head, F.lower(line).rlike(words)).otherwise(a["on"])
        return F.struct(on.alias("on"), F.when(on, F.concat(a["out"], F.array(line))).otherwise(a["out"]).alias("out"))

    found = F.aggregate(F.split(text, "\n"), zero, step, lambda a: F.array_join(a["out"], "\n"))
    return F.when(found == "", F.substring(text, 1, 3000)).otherwise(found)


#: Three shapes of a page, by the part's key.
_PAGE = "CASE p_partkey % 3 WHEN 0 THEN '== Drops ==\n' || p_name || '\n== History ==\n' || p_type || '\nIt requires 2 quests and level ' || p_size || '.\nIt is immune to melee.' WHEN 1 THEN 'About ' || p_name || '\n== Loot table ==\n' || p_brand || '\nRequirements: ' || p_size || '\nIt is weak to melee, and melee cannot hit it from afar' ELSE p_type || '\nMelee can damage it.\nOne has to equip ' || p_brand || ' at lvl ' || p_size END"
_LINES = "SELECT p_partkey, p_name, string_split(" + _PAGE.replace("\\n", "' || chr(10) || '") + ", chr(10)) AS ls FROM part"


@query(
    "section_extract",
    f"""WITH li AS ({_LINES}), l AS (SELECT p_partkey, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS line FROM li),
    h AS (SELECT *, sum(CASE WHEN starts_with(line, '=') THEN 1 ELSE 0 END) OVER (PARTITION BY p_partkey ORDER BY pos) AS part FROM l),
    s AS (SELECT *, bool_or(starts_with(line, '=') AND regexp_matches(lower(line), 'drops|loot')) OVER (PARTITION BY p_partkey, part) AS hit FROM h)
    SELECT p_partkey, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (hit), substring(string_agg(line, chr(10) ORDER BY pos), 1, 3000)) AS text FROM s GROUP BY p_partkey""",
)
def section_extract(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", section(F.expr(_PAGE), "drops|loot").alias("text"))


@query("requirement_lines", f"WITH li AS ({_LINES}) SELECT p_partkey, unnest(range(len(f)))::INT AS pos, unnest(f) AS line FROM (SELECT p_partkey, list_transform(list_filter(ls, lambda x: regexp_matches(lower(x), '{{R}}'))[1:8], lambda x: substring(x, 1, 220)) AS f FROM li) WHERE len(f) > 0 UNION ALL SELECT p_partkey, -1, 'Not explicitly stated in the provided sources. Sources: ' || p_name FROM li WHERE len(list_filter(ls, lambda x: regexp_matches(lower(x), '{{R}}'))) = 0".replace("{R}", REQUIRED))
def requirement_lines(spark: SparkSession, d: str) -> DataFrame:
    """The first eight lines that state a requirement, cut at 220 characters; without any, what was looked at (-1)."""
    lines = F.transform(F.slice(F.filter(F.split(F.expr(_PAGE), "\n"), lambda x: F.lower(x).rlike(REQUIRED)), 1, 8), lambda x: F.substring(x, 1, 220))
    p = read(spark, d, "part").select("p_partkey", "p_name", lines.alias("f"))
    none = p.filter(F.size("f") == 0).select("p_partkey", F.lit(-1).alias("pos"), F.concat(F.lit("Not explicitly stated in the provided sources. Sources: "), "p_name").alias("line"))
    return p.select("p_partkey", F.posexplode("f").alias("pos", "line")).unionByName(none)


@query(
    "verdict_quote",
    f"WITH li AS ({_LINES}), f AS (SELECT p_partkey, " + ", ".join(f"list_filter(ls, lambda x: regexp_matches(lower(x), '{in_sql(p)}'))[1] AS {v}" for v, p in VERDICTS) + " FROM li) SELECT p_partkey, CASE WHEN No IS NOT NULL THEN 'No' ELSE 'Yes' END AS verdict, substring(coalesce(No, Yes), 1, 240) AS quote FROM f WHERE coalesce(No, Yes) IS NOT NULL",
)
def verdict_quote(spark: SparkSession, d: str) -> DataFrame:
    """The first line that denies, else the first that affirms, cut at 240 characters."""
    lines = F.split(F.expr(_PAGE), "\n")
    first = lambda pattern: F.get(F.filter(lines, lambda x: F.lower(x).rlike(pattern)), F.lit(0))
    found = [first(p) for _, p in VERDICTS]
    verdict = F.coalesce(*(F.when(f.isNotNull(), v) for f, (v, _) in zip(found, VERDICTS)))
    return read(spark, d, "part").select("p_partkey", verdict.alias("verdict"), F.substring(F.coalesce(*found), 1, 240).alias("quote")).filter("verdict is not null")


_TAGGED = " UNION ALL ".join(f"SELECT conv_id, turn, text, '{k}' AS intent FROM conversations WHERE regexp_matches(lower(text), '{in_sql(INTENTS[k])}')" for k in NEUTRAL)


@query("intent_expand", "SELECT conv_id, turn, CASE intent " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NEUTRAL.items()) + f" END AS term FROM ({_TAGGED})")
def intent_expand(spark: SparkSession, d: str) -> DataFrame:
    terms = F.create_map(*(F.lit(x) for kv in NEUTRAL.items() for x in kv))
    return read(spark, d, "conversations").select("conv_id", "turn", F.explode(tags(F.col("text"))).alias("intent")).select("conv_id", "turn", F.try_element_at(terms, F.col("intent")).alias("term")).filter("term is not null")


# Terms that widen a question, by intent and in this order.
WIDER = {
    "requirements": ["requirements", "quest requirements", "skill requirements", "unlock", "completion"],
    "drops": ["drop table", "unique drops", "loot"],
    "location": ["located at", "located in", "near", "north of", "south of"],
    "stats": ["max hit", "hitpoints", "combat level"],
    "strategy": ["mechanics", "strategy", "safe spot"],
    "economy": ["price", "grand exchange", "market"],
}


def widened(q: Column) -> Column:
    """A question with the terms of its intents behind it; as it is without any."""
    terms = F.concat_ws(", ", *(F.when(F.lower(q).rlike(INTENTS[k]), F.lit(", ".join(v))) for k, v in WIDER.items()))
    return F.when(terms == "", q).otherwise(F.concat(q, F.lit(" | "), terms))


_WIDER_SQL = "concat_ws(', ', " + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{INTENTS[k]}') THEN '{', '.join(v)}' END" for k, v in WIDER.items()) + ")"


@query("intent_widened", f"SELECT conv_id, turn, CASE WHEN t = '' THEN text ELSE text || ' | ' || t END AS wider FROM (SELECT *, {_WIDER_SQL} AS t FROM conversations WHERE role = 'user')")
def intent_widened(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", widened(F.col("text")).alias("wider"))


@query("search_terms", "SELECT item_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) > 4))) AS term FROM benchmark")
def search_terms(spark: SparkSession, d: str) -> DataFrame:
    """Distinct words of a question that are longer than four characters."""
    return read(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(F.filter(tokens(F.col("text")), lambda x: F.char_length(x) > 4))).alias("term"))


# Terms that a question may name, and what words of a question add to them.
TERMS = [
    "melee", "range", "ranged", "magic", "mage", "prayer", "weapon", "armor", "armour", "shield", "helmet", "boots", "gloves", "rune", "runes", "scroll", "prayer scroll", "augury", "rigour",
    "boss", "monster", "combat", "fight", "phase", "special attack", "defence", "defense", "accuracy", "damage", "dps",
    "price", "gold", "gp", "profit", "loss", "market", "trade", "expensive", "cheap", "valuable", "worthless",
]
ADDED = [
    (["boss", "fight", "kill"], ["boss mechanics", "combat strategy", "boss drops"]),
    (["prayer", "scroll"], ["prayer scroll", "augury", "rigour", "preserve"]),
    (["range", "ranged", "mage", "magic"], ["ranged combat", "magic combat", "combat triangle"]),
    (["price", "gold", "gp", "profit", "loss"], ["market analysis", "item prices", "profit margins"]),
]


def listed_terms(q: Column) -> Column:
    """The terms that a question names anywhere and those that its words add, each once, in their order."""
    q = F.lower(q)
    named = [F.when(F.contains(q, F.lit(t)), F.lit(t)) for t in TERMS]
    more = [F.when(q.rlike("|".join(words)), F.lit(t)) for words, ts in ADDED for t in ts]
    return F.array_distinct(F.array_compact(F.array(*named, *more)))


_ASKED = "text || CASE item_id % 5 WHEN 0 THEN ' How to Kill the boss?' WHEN 1 THEN ' A prayer scroll for range' WHEN 2 THEN ' worthless gold?' WHEN 3 THEN ' special attack of a weapon' ELSE '' END"
_LISTED = ", ".join([*(f"CASE WHEN contains(q, '{t}') THEN '{t}' END" for t in TERMS), *(f"CASE WHEN regexp_matches(q, '{'|'.join(ws)}') THEN '{t}' END" for ws, ts in ADDED for t in ts)])


@query("question_terms", f"SELECT DISTINCT item_id, t AS term FROM (SELECT item_id, unnest([{_LISTED}]) AS t FROM (SELECT item_id, lower({_ASKED}) AS q FROM benchmark)) WHERE t IS NOT NULL")
def question_terms(spark: SparkSession, d: str) -> DataFrame:
    """What to search for by the words of a question."""
    return read(spark, d, "benchmark").select("item_id", F.explode(listed_terms(F.expr(_ASKED))).alias("term"))


@query("context_assemble", "SELECT source, string_agg('[' || n || '] ' || doc_id || ':' || chr(10) || substring(text, 1, 200), chr(10) ORDER BY n) AS context, sum(length(text))::BIGINT AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents QUALIFY n <= 8) GROUP BY source")
def context_assemble(spark: SparkSession, d: str) -> DataFrame:
    """Up to eight documents of a title, numbered, 200 characters of each."""
    n = F.row_number().over(W.partitionBy("source").orderBy("doc_id"))
    t = read(spark, d, "documents").select("source", "doc_id", F.substring("text", 1, 200).alias("head"), F.char_length("text").alias("size")).withColumn("n", n).filter("n <= 8")
    part = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), F.col("doc_id").cast("string"), F.lit(":\n"), "head")
    g = t.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("n", part.alias("part")))).alias("all"), F.sum("size").alias("n_chars"))
    return g.select("source", F.array_join(F.transform("all", lambda x: x["part"]), "\n").alias("context"), "n_chars")


_NAMES = "SELECT conv_id, turn, unnest(list_distinct(regexp_extract_all(text, '[A-Z][a-z]+'))) AS entity FROM conversations"


@query("turn_entities", _NAMES)
def turn_entities(spark: SparkSession, d: str) -> DataFrame:
    """Capitalised words of a turn."""
    names = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0)))
    return read(spark, d, "conversations").select("conv_id", "turn", F.explode(names).alias("entity"))


@query("entity_context", f"SELECT t.conv_id, t.turn, n.entity, max(n.turn) AS last_turn FROM (SELECT DISTINCT conv_id, turn FROM conversations) t JOIN ({_NAMES}) n ON n.conv_id = t.conv_id AND n.turn <= t.turn GROUP BY ALL")
def entity_context(spark: SparkSession, d: str) -> DataFrame:
    """What a conversation knows at each turn: every entity with the last turn up to it that named it.

    An entity holds from each turn that names it to the next that does; turns in between take it from there.
    """
    n = turn_entities(spark, d).withColumn("until", F.lead("turn").over(W.partitionBy("conv_id", "entity").orderBy("turn")))
    t = read(spark, d, "conversations").select("conv_id", F.col("turn").alias("at")).distinct()
    j = t.join(n, "conv_id").filter((F.col("turn") <= F.col("at")) & (F.col("until").isNull() | (F.col("at") < F.col("until"))))
    return j.select("conv_id", F.col("at").alias("turn"), "entity", F.col("turn").alias("last_turn"))
