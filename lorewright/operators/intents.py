"""What a question asks for: intents, the words of evidence for them, and filters of candidates that depend on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..registry import query, read
from .indexes import suggestions

# The words that speak for an intent.
INTENTS = {
    "damage_modality": "immune|immunity|cannot be damaged|only damaged by|weak to|vulnerable to|melee|magic|ranged",
    "drops": "drop|drops|unique drop|drop table",
    "requirements": "requirement|requirements|level req|level requirement|equip requirement",
    "location": "where|located|location|found in|found at|north|south|east|west|near|map",
    "stats": "stats|stat|hp|hitpoints|max hit|attack speed|combat level|defence|defense|accuracy|bestiary",
    "strategy": "how do|how to|avoid|mechanics|phase|phases|strategy|safe spot|safespot|attack cycle",
    "economy": "price|value|market|grand exchange|ge|profit|profitable|worth",
    "lore": "lore|background|story|history",
    "quests": "quest|quest requirement|start|step|subquest",
    "skills": "skill|training|xp|experience|method",
    "items": "item|equipment|weapon|armour|armor|bonuses|stats|weight",
    "npcs": "npc|monster|boss|bestiary",
    "minigames": "minigame|waves|points|reward",
    "combat_mechanics": "tick|prayer|overhead|cycle|special attack|spec|enrage",
    "equipment_stats": "stab|slash|crush|magic bonus|ranged bonus|strength bonus|prayer bonus",
    "comparison": "compare|vs|versus|difference between",
    "timeline": "update|patch|changelog|release|date|latest|newest|what's new|most recent|recent|new content|recent update",
    "slayer": "slayer|task|assigned|master|block|extend",
    "clue": "clue|emote|coordinate|cryptic",
    "spell_prayer": "spell|prayer|protect from|cast|book",
}
# The patterns of a text that bears on an intent.
PATTERNS = {
    "damage_modality": r"immune to|cannot be damaged|only (?:damaged|affected) by|weak to|vulnerable to|melee|magic|ranged",
    "drops": r"drop table|drops?|unique|rare drop table|loot",
    "requirements": r"requirements?|level|quest requirement|skill",
    "location": r"located (?:in|at|on)|found (?:in|at)|(?:north|south|east|west) of|near|island|dungeon|cave|coordinates?",
    "stats": r"hitpoints|hp|max hit|attack speed|combat level|defen[cs]e level|accuracy",
    "strategy": r"strategy|mechanics|phase|attack cycle|avoid|dodge|safe spot",
    "economy": r"price|grand exchange|ge|market|value",
    "lore": r"lore|history|background|story",
    "quests": r"quest|requirements?|start|completion|steps?",
    "skills": r"training|xp|experience|method",
    "items": r"item|equipment|bonuses|weight",
    "npcs": r"npc|monster|boss|bestiary",
    "minigames": r"minigame|waves?|points?|rewards?",
    "combat_mechanics": r"tick|overhead|prayer|attack cycle|special attack",
    "equipment_stats": r"stab|slash|crush|magic bonus|ranged bonus|strength bonus|prayer bonus",
    "comparison": r"compare|vs|versus|difference",
    "timeline": r"update|patch|changelog|release|date",
    "slayer": r"slayer|task|assigned|master|extend|block",
    "clue": r"clue|emote|coordinate|cryptic",
    "spell_prayer": r"spell|prayer|protect from|cast",
}


def in_sql(pattern: str) -> str:
    """A pattern as it stands between the quotes of SQL."""
    return pattern.replace("'", "''")


def whole(words: str) -> str:
    """A pattern for any of the words where no letter, number or underscore touches it; any engine reads it alike."""
    return rf"(?:^|[^\p{{L}}\p{{N}}_])(?:{words})(?:$|[^\p{{L}}\p{{N}}_])"


EVIDENCE = {k: whole(v) for k, v in PATTERNS.items()}
#: Intents whose questions are refused if the context holds no evidence for them.
GUARDED = ("requirements", "location", "stats", "drops")
# Words of questions about things to get and about foes, and marks of pages on things and on foes.
ITEM_WORDS = " item| items|rune |runes|buy|purchase|obtain|get|craft|smith|make|alch|grand exchange| ge |price|prices"
FOE_WORDS = "kill|slayer|task|monster|boss|burst|barrage|chinning|catacombs|dungeon|cave"
ITEM_MARKS = "items|item sets|tradeable items|untradeable items|grand exchange|drops|materials|resources|rocks|ores|enchants|crafting|consumables|pets|cosmetics|tokens|scrolls|dust|granite|sanguine|metamorphic"
ITEM_TITLES = "granite dust|sanguine dust|metamorphic dust|( dust| rocks| ore| potion| seeds)$"
FOE_TITLES, FOE_PLACES, FOE_MARKS = r"dust devil|\(monster", "catacombs|dungeon|cave", "monsters"


def tags(q: Column) -> Column:
    """The intents of a question, as listed."""
    return F.array_compact(F.array(*(F.when(F.lower(q).rlike(v), F.lit(k)) for k, v in INTENTS.items())))


def about_foes(q: Column) -> tuple[Column, Column]:
    """Whether a question is about foes and not about things, without and with what its intents say."""
    q = F.lower(q)
    item, foe = q.rlike(ITEM_WORDS), q.rlike(FOE_WORDS)
    return foe & ~item, (foe | q.rlike(INTENTS["strategy"]) | q.rlike(INTENTS["location"])) & ~item


def item_page(title: Column, categories: Column) -> Column:
    return F.lower(title).rlike(ITEM_TITLES) | F.exists(categories, lambda c: F.lower(c).rlike(ITEM_MARKS))


def foe_page(title: Column, categories: Column) -> Column:
    t = F.lower(title)
    return t.rlike(FOE_TITLES) | F.exists(categories, lambda c: F.lower(c).rlike(FOE_MARKS)) | (t.rlike(FOE_PLACES) & ~item_page(title, categories))


def keep_by_intent(candidates: DataFrame) -> DataFrame:
    """candidates (query_id, q, title, categories and more) without pages on things where the question is about foes.

    Of what is left the pages on foes, or, if a question has none, all. Whether one has any is a count for each
    question, joined back; no question's candidates need meet.
    """
    foes, page = about_foes(F.col("q"))[1], foe_page(F.col("title"), F.col("categories"))
    left = candidates.withColumn("asked_", foes).withColumn("foe_", page).filter(~F.col("asked_") | ~item_page(F.col("title"), F.col("categories")))
    by = W.partitionBy("query_id")
    return left.withColumn("any_", F.max("foe_").over(by)).filter(~F.col("asked_") | F.col("foe_") | ~F.col("any_")).drop("asked_", "foe_", "any_")


_TAGGED = " UNION ALL ".join(f"SELECT conv_id, turn, text, '{k}' AS intent FROM conversations WHERE role = 'user' AND regexp_matches(lower(text), '{in_sql(v)}')" for k, v in INTENTS.items())
_HOLDS = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS intent FROM documents WHERE regexp_matches(lower(text), '{v}')" for k, v in EVIDENCE.items())


def asked(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", "text")


@query("intent_tags", f"SELECT conv_id, turn, list_sort(list(intent)) AS intents FROM ({_TAGGED}) GROUP BY conv_id, turn")
def intent_tags(spark: SparkSession, d: str) -> DataFrame:
    return asked(spark, d).select("conv_id", "turn", F.array_sort(tags(F.col("text"))).alias("intents")).filter(F.size("intents") > 0)


@query("intent_evidence", f"SELECT intent, count(*) AS documents FROM ({_HOLDS}) GROUP BY intent")
def intent_evidence(spark: SparkSession, d: str) -> DataFrame:
    """How many documents hold evidence for each intent."""
    held = F.array_compact(F.array(*(F.when(F.lower("text").rlike(v), F.lit(k)) for k, v in EVIDENCE.items())))
    return read(spark, d, "documents").select(F.explode(held).alias("intent")).groupBy("intent").agg(F.count("*").alias("documents"))


_NEXT = "nex AS (SELECT conv_id, turn, role, text, lower(coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '')) AS context FROM conversations)"


@query(
    "evidence_guard",
    f"WITH {_NEXT} " + " UNION ALL ".join(f"SELECT conv_id, turn, '{k}' AS intent, NOT regexp_matches(context, '{EVIDENCE[k]}') AS refused FROM nex WHERE role = 'user' AND regexp_matches(lower(text), '{INTENTS[k]}')" for k in GUARDED),
)
def evidence_guard(spark: SparkSession, d: str) -> DataFrame:
    """A question is refused for a guarded intent if its context, the turn that answers it, holds no evidence."""
    context = F.lower(F.coalesce(F.lead("text").over(W.partitionBy("conv_id").orderBy("turn")), F.lit("")))
    t = read(spark, d, "conversations").select("conv_id", "turn", "role", "text", context.alias("context")).filter("role = 'user'")
    verdict = F.array_compact(F.array(*(F.when(F.lower("text").rlike(INTENTS[k]), F.struct(F.lit(k).alias("intent"), (~F.col("context").rlike(EVIDENCE[k])).alias("refused"))) for k in GUARDED)))
    return t.select("conv_id", "turn", F.explode(verdict).alias("v")).select("conv_id", "turn", "v.*")


#: Words of the lexicon with the third letter left out, each in a question of two words.
_LEX = """lex AS (SELECT w, count(*) AS freq FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY w),
    que AS (SELECT DISTINCT substring(w, 1, 2) || substring(w, 4) || ' pricess' AS question FROM lex WHERE length(w) > 4),
    tok AS (SELECT question, unnest(range(1, 3)) AS pos, unnest(string_split(question, ' ')) AS tok FROM que)"""


@query(
    "query_variants",
    f"""WITH {_LEX}, unk AS (SELECT DISTINCT tok FROM tok WHERE tok NOT IN (SELECT w FROM lex)),
    can AS (SELECT tok, w, freq, levenshtein(tok, w) AS dist FROM unk JOIN lex ON tok[1] = w[1] AND abs(length(tok) - length(w)) <= 2),
    sug AS (SELECT tok, w, round(1 - dist / greatest(length(tok), length(w))::DOUBLE, 9) AS confidence FROM can WHERE dist <= CASE WHEN length(tok) >= 5 THEN 2 ELSE 1 END),
    ran AS (SELECT *, row_number() OVER (PARTITION BY tok ORDER BY confidence DESC, freq DESC, w) AS rank FROM sug JOIN lex USING (w)),
    two AS (SELECT a.tok, a.w, a.confidence, coalesce(b.confidence >= a.confidence - 0.1, FALSE) AS unsure FROM ran a LEFT JOIN ran b ON a.tok = b.tok AND b.rank = 2 WHERE a.rank = 1),
    cor AS (SELECT question, string_agg(CASE WHEN confidence >= 0.6 THEN w ELSE tok END, ' ' ORDER BY pos) AS corrected FROM tok LEFT JOIN two USING (tok) GROUP BY question),
    amb AS (SELECT question, tok, w FROM tok JOIN two USING (tok) WHERE unsure QUALIFY row_number() OVER (PARTITION BY question ORDER BY confidence DESC, pos) = 1)
    SELECT question, 0 AS n, question AS variant FROM que UNION ALL SELECT question, 1, corrected FROM cor WHERE corrected <> question
    UNION ALL SELECT question, 2, CASE WHEN instr(question, tok) > 0 THEN substring(question, 1, instr(question, tok) - 1) || tok || ' (' || w || ')' || substring(question, instr(question, tok) + length(tok)) END FROM amb""",
)
def query_variants(spark: SparkSession, d: str) -> DataFrame:
    """A question as it is (0), with its unknown words corrected where that is sure enough (1), and with the word
    of the surest doubtful correction followed by it in brackets (2)."""
    lex = read(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("w")).groupBy("w").agg(F.count("*").alias("freq"))
    q = lex.filter(F.char_length("w") > 4).select(F.concat(F.substring("w", 1, 2), F.expr("substring(w, 4)"), F.lit(" pricess")).alias("question")).distinct()
    tok = q.select("question", F.posexplode(F.split("question", " ")).alias("pos", "tok"))
    unknown = tok.select("tok").distinct().join(lex.select(F.col("w").alias("tok")), "tok", "left_anti")
    s = suggestions(unknown, lex, 2).groupBy("tok").agg(*(F.max(F.when(F.col("rank") == r, F.col(c))).alias(f"{c}{r}") for r, c in ((1, "w"), (1, "confidence"), (2, "confidence"))))
    j = tok.join(s, "tok", "left").withColumn("unsure", F.coalesce(F.col("confidence2") >= F.col("confidence1") - 0.1, F.lit(False)))
    word = F.when(F.col("confidence1") >= 0.6, F.col("w1")).otherwise(F.col("tok"))
    g = j.groupBy("question").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", word.alias("w")))), lambda x: x["w"]), " ").alias("corrected"),
        F.min(F.when(F.col("unsure"), F.struct((-F.col("confidence1")).alias("c"), "pos", "tok", F.col("w1").alias("w")))).alias("a"),
    )
    at = F.instr(F.col("question"), F.col("a.tok"))
    hint = F.concat(F.substring(F.col("question"), F.lit(1), at - 1), "a.tok", F.lit(" ("), "a.w", F.lit(")"), F.substring(F.col("question"), at + F.char_length("a.tok"), F.char_length("question")))
    three = F.array(F.col("question"), F.when(F.col("corrected") != F.col("question"), F.col("corrected")), F.when(F.col("a").isNotNull(), hint))
    return g.select("question", F.posexplode(three).alias("n", "variant")).filter("variant is not null")


__all__ = ["EVIDENCE", "GUARDED", "INTENTS", "about_foes", "foe_page", "item_page", "keep_by_intent", "suggestions", "tags"]
