"""Pages rendered by tables of rules: templates dealt to families by a first-match join, their parameters labelled by a
join, and what they stand for put back by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import decode_entities, sql_decode
from ..joins import lookup
from ..registry import query, read
from ..staging import scratch, stage
from .families import CONSTANT, FORMS, FRAMES, LABELS, LEFT_BEHIND, READABLE, RULES, text_of, title_case, value
from .templates import _OLD_SQL, _sql_rules, apply_rules, issues, legacy_fixed, templates


def rules(spark: SparkSession) -> DataFrame:
    """(priority, kind, word, also, family): a name has the family of the first rule whose word it is, begins or ends with,
    or holds, and that holds `also` too (if it is not null)."""
    return spark.createDataFrame([(n, *r) for n, r in enumerate(RULES)], "priority int, kind string, word string, also string, family string")


def dispatch(names: DataFrame) -> DataFrame:
    """(name, family) for distinct names; a name that no rule takes is of the family "generic".

    Every beginning, end and piece of a name that has the length of some rule's word is looked up by equality, so a name
    meets the rules of its own words only.
    """
    spark = names.sparkSession
    n, size = F.col("low"), F.char_length("low")
    lengths = lambda kind: sorted({len(word) for k, word, _, _ in RULES if k == kind})
    key = lambda kind, word: F.struct(F.lit(kind).alias("kind"), word.alias("word"))
    keys = [key("exact", n), *(key("prefix", F.when(size >= k, F.substring(n, 1, k))) for k in lengths("prefix")), *(key("suffix", F.when(size >= k, F.substring(n, -k, k))) for k in lengths("suffix"))]
    pieces = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(size - k + 1, F.lit(1))), lambda i: key("inner", F.substring(n, i, F.lit(k))))
    inner = [pieces(k) for k in lengths("inner")]
    asked = names.select("name", F.lower("name").alias("low")).withColumn("key", F.explode(F.array_distinct(F.concat(F.array(*keys), *inner))))
    hit = asked.select("name", "low", "key.*").join(F.broadcast(rules(spark)), ["kind", "word"]).filter("also is null or contains(low, also)")
    first = hit.groupBy("name").agg(F.min_by("family", "priority").alias("family"))
    return names.select("name").join(first, "name", "left").select("name", F.coalesce("family", F.lit("generic")).alias("family"))


def labels(spark: SparkSession) -> DataFrame:
    """(family, low, label): labels of parameters that are not their key with capitals."""
    rows = [(family, k, v) for family, of in LABELS.items() for k, v in of.items()]
    rows += [("infobox", f"{k}{n}", f"{v} (Form {n})") for k, (v, ns) in FORMS.items() for n in ns]
    return spark.createDataFrame(rows, "family string, low string, label string")


def frames(spark: SparkSession) -> DataFrame:
    """(family, head, sep, tail, none): what stands before, between and after a family's labelled parameters, and what
    stands if it has none (null: head and tail)."""
    return spark.createDataFrame([(k, *v) for k, v in FRAMES.items()], "family string, head string, sep string, tail string, none string")


def labelled(rows: DataFrame, id_: list[str]) -> DataFrame:
    """(id_, labelled) for template rows (id_, name, family, params) of labelled families: each parameter as "Label: value".

    Of a repeated parameter the last value stands at the place of the first. Empty values are left out (but for combat
    stats, of which only those with a label count).
    """
    spark = rows.sparkSession
    p = rows.join(F.broadcast(frames(spark)), "family").select(*id_, "name", "family", "head", "sep", "tail", "none", F.posexplode_outer("params").alias("n", "p"))
    p = p.select(*id_, "name", "family", "head", "sep", "tail", "none", "n", F.col("p.key").alias("key"), F.col("p.value").alias("value"))
    whole = ["name", "family", "head", "sep", "tail", "none"]
    p = p.groupBy(*id_, *whole, "key").agg(F.min("n").alias("at"), F.max_by("value", "n").alias("value"))
    low = F.trim(F.lower("key"))
    p = p.withColumn("low", low).join(F.broadcast(labels(spark)), ["family", "low"], "left")
    combat, generic = F.col("family") == "combat stats", F.col("family") == "generic"
    counts = F.when(combat, F.col("label").isNotNull()).otherwise((F.col("value") != "") & ~(generic & F.startswith("key", F.lit("_"))))
    shown = F.when(counts, F.struct("at", F.concat(F.coalesce("label", title_case(F.replace("key", F.lit("_"), F.lit(" ")))), F.lit(": "), "value").alias("line")))
    g = p.groupBy(*id_, *whole).agg(F.array_sort(F.collect_list(shown)).alias("lines"))
    body = F.call_function("array_join", F.transform("lines", lambda x: x["line"]), F.col("sep"))
    of = F.trim(F.replace("name", F.lit("Infobox"), F.lit("")))
    head = F.when(F.col("family") == "infobox", F.when(of != "", F.concat(F.lit("=== "), of, F.lit(" Information ==="))).otherwise("")).when(generic, F.col("name")).otherwise(F.col("head"))
    between = F.when((head == "") | (F.size("lines") == 0) | F.endswith(head, F.lit(" ")), "").when(generic, ": ").otherwise(F.col("sep"))
    text = F.when((F.size("lines") == 0) & F.col("none").isNotNull(), F.col("none")).otherwise(F.concat(head, between, body, "tail"))
    return g.select(*id_, text.alias("labelled"))


def template_rows(pages: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, pos, s, e, name, family, params, text): the outermost templates of each page (key unique), with their families
    and what they stand for. Stored once as parsed; names are dealt to families once each, however often they occur."""
    spark = pages.sparkSession
    rows = pages.select(key, F.posexplode(templates(F.col(raw))).alias("pos", "x")).select(key, "pos", "x.*")
    rows = stage(rows, "templates")
    # names differ little from page to page: one row each, also of a table of any size
    named = stage(dispatch(rows.select("name").distinct()), "families")
    rows = stage(lookup(rows, named, ["name"]), "templates")
    lines = labelled(rows.filter(F.col("family").isin(*FRAMES)), [key, "pos"])
    fixed = text_of(F.col("name"), F.col("family"), F.col("params"))
    j = rows.join(lines, [key, "pos"], "left")
    return j.select(key, "pos", "s", "e", "name", "family", "params", F.coalesce("labelled", fixed, F.lit("")).alias("text"))


def family(low: Column) -> Column:
    """The family of a lowered name, as dispatch() deals it."""
    out = None
    for kind, word, also, to in RULES:
        hit = {"exact": low == word, "prefix": F.startswith(low, F.lit(word)), "suffix": F.endswith(low, F.lit(word)), "inner": F.contains(low, F.lit(word))}[kind]
        hit = hit if also is None else hit & F.contains(low, F.lit(also))
        out = F.when(hit, to) if out is None else out.when(hit, to)
    return out.otherwise("generic")


def _let(x: Column, f) -> Column:
    """f of x, with x evaluated once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def labelled_text(of: str, name: Column, params: Column) -> Column:
    """What labelled() gives for a template of the family, within its row."""
    head, sep, tail, none = FRAMES[of]
    named = LABELS.get(of, {}) | ({f"{k}{n}": f"{v} (Form {n})" for k, (v, ns) in FORMS.items() for n in ns} if of == "infobox" else {})
    label = (lambda key: F.element_at(F.create_map(*(F.lit(x) for kv in named.items() for x in kv)), F.trim(F.lower(key)))) if named else (lambda key: F.lit(None).cast("string"))
    first = F.filter(params, lambda p, i: ~F.exists(F.slice(params, F.lit(1), i), lambda q: q["key"] == p["key"]))
    rows = F.transform(first, lambda p: F.struct(p["key"].alias("key"), value(params, p["key"]).alias("value"), label(p["key"]).alias("label")))
    counts = {"combat stats": lambda p: p["label"].isNotNull(), "generic": lambda p: (p["value"] != "") & ~F.startswith(p["key"], F.lit("_"))}.get(of, lambda p: p["value"] != "")
    lines = F.transform(F.filter(rows, counts), lambda p: F.concat(F.coalesce(p["label"], title_case(F.replace(p["key"], F.lit("_"), F.lit(" ")))), F.lit(": "), p["value"]))
    bare = F.trim(F.replace(name, F.lit("Infobox"), F.lit("")))
    head = {"infobox": F.when(bare != "", F.concat(F.lit("=== "), bare, F.lit(" Information ==="))).otherwise(""), "generic": name}.get(of, F.lit(head))
    between = F.when((head == "") | F.endswith(head, F.lit(" ")), "").otherwise(": " if of == "generic" else sep)
    empty = F.concat(head, F.lit(tail)) if none is None else F.lit(none)
    return _let(lines, lambda x: F.when(F.size(x) == 0, empty).otherwise(F.concat(head, between, F.array_join(x, sep), F.lit(tail))))


def pieces_of(t: Column) -> Column:
    """(s, e, text) of the outermost templates of a text, in order, within its row."""
    rows = F.transform(templates(t), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["name"].alias("name"), x["params"].alias("params"), F.lower(x["name"]).alias("low")))
    rows = F.transform(rows, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["name"].alias("name"), x["params"].alias("params"), family(x["low"]).alias("family")))

    def text(x: Column) -> Column:
        out = F.when(F.lit(False), F.lit(""))
        for of in FRAMES:
            out = out.when(x["family"] == of, labelled_text(of, x["name"], x["params"]))
        return F.coalesce(out.otherwise(text_of(x["name"], x["family"], x["params"])), F.lit(""))

    return F.transform(rows, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), text(x).alias("text")))


def put_back(t: Column, pieces: Column) -> Column:
    """t with each span (s, e) of the sorted pieces replaced by its text."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    step = lambda a, x: F.struct(x["e"].alias("at"), F.concat(a["out"], F.array(F.substring(t, a["at"] + 1, x["s"] - a["at"]), x["text"])).alias("out"))
    return F.aggregate(pieces, zero, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(t, a["at"] + 1, F.char_length(t))))


def rendered(pages: DataFrame, key: str, raw: str, text: str | None = None) -> DataFrame:
    """(key, rendered): pages with each outermost template replaced by what it stands for; those without any as they are.

    With `text`, a page whose raw text is null or empty has that text rendered in its place. A page is rendered within its
    row: nothing is shuffled or stored.
    """
    from_ = F.col(raw) if text is None else F.when(F.coalesce(raw, F.lit("")) == "", F.col(text)).otherwise(F.col(raw))
    return pages.select(key, from_.alias("from_")).select(key, put_back(F.col("from_"), pieces_of(F.col("from_"))).alias("rendered"))


def readable(t: Column) -> Column:
    """Rendered text as plain text: character references first, then the rules for markup."""
    return apply_rules(decode_entities(t), READABLE)


def _page(d: DataFrame, forms: list[tuple[str, str]]) -> DataFrame:
    """Parts with a page of templates, made by SQL that Spark and DuckDB read alike."""
    return d.selectExpr("p_partkey", f"concat_ws(' and ', {', '.join(raw for raw, _ in forms)}) AS raw")


def _want(forms: list[tuple[str, str]]) -> str:
    return f"SELECT p_partkey, unnest(range({len(forms)}))::INTEGER AS pos, unnest([{', '.join(want for _, want in forms)}]) AS text FROM part"


_PATTERN_FORMS = [
    ("'{{Map|name=' || p_name || '|x=' || p_size || '|y=' || p_partkey || '}}'", "'Map: ' || p_name || ' | Coordinates: (' || p_size || ', ' || p_partkey || ')'"),
    ("'{{Map|x=' || p_size || '}}'", "'[Map]'"),
    ("'{{GP|' || p_size || '}}'", "p_size || ' coins'"),
    ("'{{FloorNumber|uk=' || p_size % 5 || '}}'", "CASE p_size % 5 WHEN 0 THEN 'Ground Floor' WHEN 1 THEN '1st Floor' WHEN 2 THEN '2nd Floor' WHEN 3 THEN '3rd Floor' ELSE '4th Floor' END"),
    ("'{{Recipe|skill1=smithing|skill1lvl=' || p_size || '|mat1=' || p_name || '|mat3=' || p_type || '|output1=' || p_brand || '}}'", "'Requires: ' || p_size || ' Smithing | Materials: ' || p_name || ', ' || p_type || ' | Creates: ' || p_brand"),
    ("'{{EmoteClue|tier=hard|item2=' || p_name || '}}'", "'Clue Tier: Hard | Required Items: ' || p_name"),
    ("'{{Subject changes|date=1 May|change=' || repeat('x', p_size + 80) || '}}'", "'Update Date: 1 May | Change: ' || CASE WHEN p_size > 20 THEN repeat('x', 100) || '...' ELSE repeat('x', p_size + 80) END"),
    ("'{{plink|' || p_name || '|txt=' || p_type || '}}'", "'[[' || p_name || '|' || p_type || ']]'"),
    ("'{{SCP|' || CASE WHEN p_size % 2 = 0 THEN 'mining' ELSE 'quest' END || '|' || p_size || '}}'", "CASE WHEN p_size % 2 = 0 THEN 'Mining Level: ' ELSE 'Quest Points: ' END || p_size"),
    ("'{{Boostable|' || CASE WHEN p_size % 2 = 0 THEN 'yes' ELSE 'no' END || '}}'", "CASE WHEN p_size % 2 = 0 THEN '[Boostable]' ELSE '[Not Boostable]' END"),
    ("'{{HasTranscript|npc}}'", "'[Transcript Available]'"),
    ("'{{Relative location|location=' || p_brand || '|west=' || p_type || '}}'", "'Location: ' || p_brand || ' | West: ' || p_type"),
    ("'{{CiteTwitter|user=' || p_partkey || '}}'", "'[Twitter: @' || p_partkey || ']'"),
    ("'{{efn|' || p_type || '}}'", "'[Note: ' || p_type || ']'"),
    ("'{{Re|' || p_brand || '}}'", "'[See: ' || p_brand || ']'"),
    ("'{{Respell|a|' || p_name || '}}'", "'Also known as: ' || p_name"),
    ("'{{ItemSpawnLine|name=' || p_name || '|members=Yes}}'", "'Item: ' || p_name || ' | Members: Yes'"),
    ("'{{Rune weapons}}'", "'=== Rune Weapons ==='"),
]
_LABEL_FORMS = [
    ("'{{DropsLine|name=' || p_name || '|quantity=' || p_size || '|rarity=|Alt_note=' || p_brand || '}}'", "'Item Name: ' || p_name || ' | Quantity: ' || p_size || ' | Alt Note: ' || p_brand"),
    ("'{{DropsLineClue}}'", "'[Drop Entry]'"),
    ("'{{DiarySkillStats|mining=' || p_size || '|rune_craft=' || p_partkey || '}}'", "'Skill Requirements: Mining: ' || p_size || ', Rune Craft: ' || p_partkey"),
]
#: Families whose parameters are labelled, and names of no rule.
_LABEL_FORMS += [
    (
        "'{{Infobox Item' || chr(10) || '|name = ' || p_name || chr(10) || '|value = ' || p_size || chr(10) || '|examine=' || chr(10) || '|high_alch2 = ' || p_brand || chr(10) || '|value=' || p_partkey || chr(10) || '}}'",
        "'=== Item Information ===' || chr(10) || 'Item Name: ' || p_name || chr(10) || 'Value: ' || p_partkey || chr(10) || 'High Alch2: ' || p_brand",
    ),
    ("'{{Combat stats|att=' || p_size || '|hp=|odd=1|mage=' || p_partkey || '}}'", "'Combat Stats: Attack: ' || p_size || ', Hitpoints: , Magic: ' || p_partkey"),
    ("'{{Stats|odd=1}}'", "''"),
    ("'{{Odd {{Sub|' || p_size || '}}}}'", "'Odd {{Sub: Parameter 1: ' || p_size || '}}'"),
    ("'{{Infobox Quest|name=' || p_name || '|difficulty=' || p_type || '}}'", "'=== Quest Information ===' || chr(10) || 'Quest Name: ' || p_name || chr(10) || 'Difficulty: ' || p_type || chr(10)"),
    ("'{{Infobox NPC|race=' || p_type || '}}'", "'=== NPC Information ===' || chr(10) || 'Race: ' || p_type"),
    ("'{{Infobox Location|type=' || p_type || '|map=}}'", "'=== Location Information ===' || chr(10) || 'Location Type: ' || p_type"),
    ("'{{Infobox skill|table=' || p_type || '}}'", "'=== Skill Information ===' || chr(10) || 'Training Table: ' || p_type"),
    (
        "'{{Infobox Monster|max hit2=' || p_size || '|examine1=' || p_brand || '|id=7|item''s_use=x}}'",
        "'=== Monster Information ===' || chr(10) || 'Maximum Hit (Form 2): ' || p_size || chr(10) || 'Examine Text (Form 1): ' || p_brand || chr(10) || 'NPC ID: 7' || chr(10) || 'Item''S Use: x' || chr(10)",
    ),
    ("'{{Infobox}}'", "chr(10)"),
    ("'{{Infobox Bonuses|astab=' || p_size || '}}'", "'=== Combat Bonuses ===' || chr(10) || 'Stab Attack Bonus: ' || p_size || chr(10)"),
    ("'{{QuestDetails|start=' || p_type || '}}'", "'=== Quest Details ===' || chr(10) || 'Start Point: ' || p_type"),
    ("'{{New thing}}'", "'New thing'"),
    ("'{{New thing|' || p_name || '|_hidden=1|x=' || p_size || '|alch=}}'", "'New thing: Parameter 1: ' || p_name || ', X Coordinate: ' || p_size"),
    ("'{{DiarySkillStats}}'", "'Skill Requirements'"),
]
# a name of each constant family: the shortest word of its rule, and a parameter that does not count
_NAMES = {"drops head": "DropsTableHead", "drops bottom": "DropsTableBottom", "changes header": "Changes header"}
_NAMES = {to: w for _, w, _, to in reversed(RULES) if to in CONSTANT} | _NAMES
_CONSTANT_FORMS = [(f"'{{{{{_NAMES[k]}|' || p_name || '}}}}'", f"'{v}'") for k, v in CONSTANT.items()]
_FORMS = {"pattern": _PATTERN_FORMS, "labelled": _LABEL_FORMS, "constant": _CONSTANT_FORMS}


def _texts(spark: SparkSession, d: str, forms: str) -> DataFrame:
    with scratch(spark) as keep:
        return keep(template_rows(_page(read(spark, d, "part"), _FORMS[forms]), "p_partkey", "raw").select("p_partkey", "pos", "text"))


@query("template_pattern", _want(_PATTERN_FORMS))
def template_pattern(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d, "pattern")


@query("template_labelled", _want(_LABEL_FORMS))
def template_labelled(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d, "labelled")


@query("template_constant", _want(_CONSTANT_FORMS))
def template_constant(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d, "constant")


#: A page with templates of all families, prose between them and an unclosed one; pages of some sizes have no raw text.
_ALL = [*_LABEL_FORMS, *_PATTERN_FORMS, *_CONSTANT_FORMS]
_BETWEEN = "' and [[' || p_brand || '|it]] &amp; '"
_PAGE_SQL = f" || {_BETWEEN} || ".join(raw for raw, _ in _ALL) + " || ' {{open'"
_SHOWN_SQL = f" || {_BETWEEN} || ".join(want for _, want in _ALL) + " || ' {{open'"
_PLAIN_SQL = "p_name || ' {{GP|' || p_size || '}}'"
_WANT_SQL = f"CASE WHEN p_size % 5 = 0 THEN p_name || ' ' || p_size || ' coins' ELSE {_SHOWN_SQL} END"


#: Pages of one task: a file of parts that one task reads becomes pages of a thousand times its bytes.
PAGES = 1024


def pages_of_all_families(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part")
    part = part.repartition(max(1, -(-part.count() // PAGES)), "p_partkey")
    return part.selectExpr("p_partkey", f"CASE WHEN p_size % 5 <> 0 THEN {_PAGE_SQL} END AS raw", f"{_PLAIN_SQL} AS text")


@query("template_render", f"SELECT p_partkey, {_WANT_SQL} AS text FROM part")
def template_render(spark: SparkSession, d: str) -> DataFrame:
    """Whole pages over all families; a page without raw text is rendered from its text."""
    return rendered(pages_of_all_families(spark, d), "p_partkey", "raw", "text").withColumnRenamed("rendered", "text")


@query("template_dispatch", "SELECT family, count(*) AS templates FROM (" + " UNION ALL ".join(f"SELECT '{family}' AS family FROM part" for family in [
    "drops line", "drops line", "diary stats", "item", "combat stats", "combat stats", "generic", "quest", "npc", "location", "skill", "infobox", "infobox", "bonuses", "quest details", "generic", "generic", "diary stats",
]) + ") GROUP BY family")
def template_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """How many templates each family has."""
    with scratch(spark) as keep:
        rows = keep(template_rows(_page(read(spark, d, "part"), _LABEL_FORMS), "p_partkey", "raw"))
        return rows.groupBy("family").agg(F.count("*").alias("templates"))


@query("page_readable", f"SELECT p_partkey, {_sql_rules(sql_decode(f'({_WANT_SQL})'), READABLE)} AS text FROM part")
def page_readable(spark: SparkSession, d: str) -> DataFrame:
    """Rendered pages as plain text."""
    return template_render(spark, d).select("p_partkey", readable(F.col("text")).alias("text"))


_NL = "chr(10)"
_READABLE_SQL = f"'== ' || p_brand || ' ==' || {_NL} || {_NL} || {_NL} || {_NL} || '  [[' || p_brand || '|the brand]]  is ''''''bold''''''.It has sizeOf: ' || p_size || 'Items. |a|' || p_name || '|' || p_size || ' <b>x</b>{{{{Sub|1}}}}'"
_BEHIND_SQL = f"'[[' || p_name || '|text]] [[' || p_brand || ']]' || {_NL} || 'Image1: a.png' || {_NL} || ' left|140px' || {_NL} || '130px | right' || {_NL} || '1: 300px' || {_NL} || '2:' || {_NL} || 'size 3: x277px ' || p_size || {_NL} || 'thumb|y' || {_NL} || '[show] v' || {_NL} || 'v • d • e' || {_NL} || repeat('• ', p_size) || {_NL} || '[https://a.example/b ' || p_type || ']<!-- c -->{{{{ }}}}' || {_NL} || '{{{{open'"


@query("wiki_readable", f"SELECT p_partkey, {_sql_rules(_READABLE_SQL, READABLE)} AS text FROM part")
def wiki_readable(spark: SparkSession, d: str) -> DataFrame:
    """Rendered text made readable by all its rules; white space at either end goes."""
    p = read(spark, d, "part").selectExpr("p_partkey", f"{_READABLE_SQL} AS t".replace("''''''", "\\'\\'\\'"))
    return p.select("p_partkey", apply_rules(F.col("t"), READABLE).alias("text"))


@query("wikitext_left_behind", f"SELECT p_partkey, {_sql_rules(_BEHIND_SQL, LEFT_BEHIND)} AS text FROM part")
def wikitext_left_behind(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").selectExpr("p_partkey", f"{_BEHIND_SQL} AS t")
    return p.select("p_partkey", apply_rules(F.col("t"), LEFT_BEHIND).alias("text"))


#: Artefacts around the text of a part.
_NOISE_SQL = "'<!-- x -->left|140px ' || p_name || ' 1: 300px [https://a.example/b ' || p_brand || '] [[File:x.png]]{{ | }}'"


_PROSE_SQL = "chr(10) || '' || p_name || ' is made by [[' || p_brand || '|them]] as [[' || p_type || ']]. &lt;&amp;' || chr(10)"


@query("wiki_markup_clean", f"SELECT p_partkey, {_sql_rules(sql_decode(_PROSE_SQL), READABLE)} AS text FROM part")
def wiki_markup_clean(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").selectExpr("p_partkey", _PROSE_SQL.replace("''''''''", "repeat(chr(39), 3)").replace("''''''' is", "' || repeat(chr(39), 3) || ' is") + " AS t")
    return p.select("p_partkey", readable(F.col("t")).alias("text"))


@query("wikitext_clean", f"SELECT p_partkey, {_sql_rules(_NOISE_SQL, LEFT_BEHIND)} AS text FROM part")
def wikitext_clean(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", apply_rules(F.expr(_NOISE_SQL), LEFT_BEHIND).alias("text"))


def reprocessed(spark: SparkSession, d: str) -> DataFrame:
    """Pages with old tokens or raw text (sizes that five divides have none), and their text made anew."""
    p = read(spark, d, "part").selectExpr("p_partkey", f"{_OLD_SQL} as text", "case when p_size % 5 <> 0 then concat(p_name, ' {{Coins|', p_size, '}}') end as raw")
    new = rendered(p.filter("raw is not null"), "p_partkey", "raw")
    j = p.join(new, "p_partkey", "left")
    return j.withColumn("new_text", F.coalesce("rendered", legacy_fixed(F.col("text")))).withColumn("changed", F.col("new_text") != F.col("text"))


_REPRO = "r AS (SELECT p_partkey, p_size % 5 = 0 AS missing, CASE WHEN p_size % 5 <> 0 THEN p_name || ' ' || p_size || ' coins' WHEN p_size % 2 = 0 THEN p_name || ' Skill requirements: ' || p_brand || ' Spawn: ' || p_type ELSE p_name END AS new_text, p_size % 5 <> 0 OR p_size % 2 = 0 AS changed FROM part)"


@query("reprocess_changed", f"WITH {_REPRO} SELECT p_partkey, new_text FROM r WHERE changed")
def reprocess_changed(spark: SparkSession, d: str) -> DataFrame:
    return reprocessed(spark, d).filter("changed").select("p_partkey", "new_text")


@query("repair_summary", f"WITH {_REPRO} SELECT count(*) AS total, count(*) FILTER (WHERE NOT missing) AS had_raw, count(*) FILTER (WHERE missing) AS no_raw, count(*) FILTER (WHERE changed) AS changed FROM r")
def repair_summary(spark: SparkSession, d: str) -> DataFrame:
    count = lambda c, n: F.count(F.when(c, 1)).alias(n)
    return reprocessed(spark, d).agg(F.count("*").alias("total"), count(F.col("raw").isNotNull(), "had_raw"), count(F.col("raw").isNull(), "no_raw"), count(F.col("changed"), "changed"))


_ISSUES = "SELECT p_partkey, unnest(list_filter([CASE WHEN p_size % 2 = 0 THEN 'legacy_bracket_tokens' END, CASE WHEN p_size % 5 = 0 THEN 'missing_raw_wikitext' END, CASE WHEN p_size % 7 = 0 AND p_size % 3 <> 0 THEN 'unparsed_templates' END], lambda x: x IS NOT NULL)) AS issue FROM part"


@query("template_issues", _ISSUES)
def template_issues(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").selectExpr("p_partkey", f"{_OLD_SQL} || repeat('{{{{x}}}}', case when p_size % 7 = 0 then 6 else 5 end) || case when p_size % 3 = 0 then 'Location: here' else '' end as text", "case when p_size % 5 <> 0 then 'raw' end as raw")
    return p.select("p_partkey", F.explode(issues(F.col("text"), F.col("raw"))).alias("issue"))


@query("issue_report", f"SELECT issue, count(*) AS pages, min(p_partkey) AS first_page FROM ({_ISSUES}) GROUP BY issue")
def issue_report(spark: SparkSession, d: str) -> DataFrame:
    return template_issues(spark, d).groupBy("issue").agg(F.count("*").alias("pages"), F.min("p_partkey").alias("first_page"))


def with_past(found: DataFrame, past: DataFrame, key: str) -> DataFrame:
    """Issues found now together with those of a past log; one that both name stands once, as found now."""
    every = found.select(key, "issue", F.lit(0).alias("age")).unionByName(past.select(key, "issue", F.lit(1).alias("age")))
    return every.groupBy(key, "issue").agg(F.when(F.min("age") == 0, "found").otherwise("past").alias("known"))


_PAST = "SELECT p_partkey, 'legacy_bracket_tokens' AS issue FROM part WHERE p_size % 3 = 0"


@query("issue_report_with_past", f"""WITH e AS (SELECT *, 0 AS age FROM ({_ISSUES}) UNION ALL SELECT *, 1 FROM ({_PAST})), k AS (SELECT p_partkey, issue, min(age) AS age FROM e GROUP BY ALL)
    SELECT issue, CASE WHEN age = 0 THEN 'found' ELSE 'past' END AS known, count(*) AS pages, min(p_partkey) AS first_page FROM k GROUP BY issue, age""")
def issue_report_with_past(spark: SparkSession, d: str) -> DataFrame:
    """Pages to fetch again by issue, of this run and of the log of earlier ones (here, by the part's size)."""
    past = read(spark, d, "part").filter("p_size % 3 = 0").select("p_partkey", F.lit("legacy_bracket_tokens").alias("issue"))
    g = with_past(template_issues(spark, d), past, "p_partkey").groupBy("issue", "known")
    return g.agg(F.count("*").alias("pages"), F.min("p_partkey").alias("first_page"))


@query("repair_missing", f"WITH {_REPRO} SELECT DISTINCT 'Part ' || p_partkey AS title FROM r WHERE missing")
def repair_missing(spark: SparkSession, d: str) -> DataFrame:
    """The titles that lack raw text, each once, in order."""
    t = reprocessed(spark, d).filter("raw is null")
    return t.select(F.concat(F.lit("Part "), F.col("p_partkey").cast("string")).alias("title")).distinct().orderBy("title")
