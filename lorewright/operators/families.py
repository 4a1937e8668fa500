"""Template families: tables of rules, labels, frames and patterns, and the text of patterns and constants.

A pattern is a list of pieces: a piece is written if the template has all the parameters that it names. What runs
over these tables is in rendering.py.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# How a lowered name is matched, the words, the family; the first match wins.
_WORDS = [
    *(("exact", [f"infobox {k}"], k) for k in ("quest", "item", "bonuses", "npc", "location", "skill")),
    ("prefix", ["infobox"], "infobox"),
    ("inner", ["combat"], "combat stats"),
    ("exact", ["stats"], "combat stats"),
    ("prefix", ["dropsline"], "drops line"),
    ("prefix", ["dropstable"], "drops head"),
    ("prefix", ["dropstable"], "drops bottom"),
    ("prefix", ["dropstable"], "drops table"),
    ("exact", ["recipe", "creation"], "recipe"),
    ("prefix", ["locline"], "location line"),
    ("prefix", ["emoteclue"], "emote clue"),
    ("exact", ["external"], "external"),
    ("exact", ["otheruses"], "other uses"),
    ("exact", ["confuse"], "confuse"),
    ("prefix", ["subject changes"], "subject changes"),
    ("exact", ["map"], "map"),
    ("prefix", ["relative location"], "relative location"),
    ("exact", ["boostable"], "boostable"),
    ("exact", ["hastranscript"], "transcript"),
    ("prefix", ["thieving info"], "thieving info"),
    ("prefix", ["skilling success"], "success chart"),
    ("prefix", ["equipment"], "equipment"),
    ("prefix", ["inventory"], "inventory"),
    ("prefix", ["combatsty"], "combat styles"),
    ("prefix", ["floornumber"], "floor"),
    ("prefix", ["stashlocation"], "stash"),
    ("exact", ["diaryskillstats", "diary skill stats"], "diary stats"),
    ("exact", ["itemspawntablehead"], "spawn head"),
    ("exact", ["itemspawnline"], "spawn line"),
    ("exact", ["itemspawntablebottom"], "spawn bottom"),
    ("exact", ["plink", "pl"], "page link"),
    ("exact", ["efn", "footnote"], "footnote"),
    ("exact", ["scp", "skill calculator"], "skill level"),
    ("exact", ["quest details", "questdetails"], "quest details"),
    ("exact", ["questreqstart", "quest req start"], "quest start"),
    ("exact", ["*", "bullet"], "bullet"),
    ("exact", ["pagename"], "page name"),
    ("exact", ["sic"], "sic"),
    ("exact", ["re", "redirect"], "redirect"),
    ("exact", ["^", "up"], "up"),
    ("prefix", ["average drop"], "average drop"),
    ("exact", ["okay", "ok"], "ok"),
    ("prefix", ["ipac"], "pronunciation"),
    ("prefix", ["citetwitter"], "citation"),
    ("prefix", ["questreq"], "quest requirement"),
    ("prefix", ["fairycode"], "fairy code"),
    ("exact", ["uses material list", "uses materials"], "materials"),
    ("exact", ["drop sources", "dropsources"], "drop sources"),
    ("exact", ["store locations list", "shop locations"], "shops"),
    ("exact", ["used in recommended equipment", "recommended equipment"], "recommended"),
    ("exact", ["sherlockchallenge", "sherlock challenge"], "sherlock"),
    ("exact", ["faloitem", "falo item"], "falo"),
    ("exact", ["reflist", "references"], "references"),
    ("exact", ["main", "main article"], "main article"),
    ("exact", ["citation", "cite", "citeforum", "citenews"], "citation"),
    ("exact", ["mmgsection", "money making"], "money making"),
    ("exact", ["sync", "synchronize"], "sync"),
    ("exact", ["has calculator", "calculator"], "calculator"),
    ("exact", ["has skill guide", "skill guide"], "skill guide"),
    ("exact", ["listen", "audio"], "audio"),
    ("exact", ["instance", "instanced"], "instance"),
    ("exact", ["hasstrategy", "has strategy"], "strategy"),
    ("exact", ["droplogproject", "drop log"], "drop log"),
    ("exact", ["drop value"], "drop value"),
    ("exact", ["respell", "spelling"], "respell"),
    ("exact", ["changes header"], "changes header"),
    ("exact", ["relativelocation"], "relative location"),
    ("exact", ["fact", "citation needed"], "fact"),
    ("exact", ["coins", "gp"], "coins"),
    ("exact", ["members", "member"], "members"),
    ("exact", ["skills", "skill"], "skill link"),
    ("exact", ["bosses", "boss"], "boss"),
    ("suffix", [" weapons", " equipment"], "equipment category"),
]
# What a name must hold besides the word of its rule.
_ALSO = {"drops head": "head", "drops bottom": "bottom"}
#: Rows of (kind, word, also, family) in order of priority.
RULES = [(kind, w, "stats" if kind == "inner" else _ALSO.get(family), family) for kind, ws, family in _WORDS for w in ws]

# The text of families whose parameters do not count.
CONSTANT = {
    "drops head": "=== Drop Table ===",
    "drops bottom": "",
    "drops table": "[Drop Table]",
    "external": "[External Link]",
    "other uses": "[See Also]",
    "confuse": "[Disambiguation]",
    "success chart": "[Success Rate Chart]",
    "equipment": "[Equipment Setup]",
    "inventory": "[Inventory Setup]",
    "spawn head": "=== Item Spawn Locations ===",
    "bullet": "•",
    "page name": "[Page Name]",
    "sic": "[sic]",
    "up": "↑",
    "average drop": "[Average Drop Value]",
    "ok": "[OK]",
    "pronunciation": "[Pronunciation Guide]",
    "quest requirement": "[Quest Requirement]",
    "materials": "=== Creation Materials ===",
    "drop sources": "=== Drop Sources ===",
    "shops": "=== Shop Locations ===",
    "recommended": "=== Recommended Equipment ===",
    "references": "=== References ===",
    "money making": "=== Money Making Guide ===",
    "sync": "Content synchronized with main wiki",
    "calculator": "Calculator Available",
    "skill guide": "Skill Guide Available",
    "instance": "Instanced Area",
    "strategy": "Strategy Guide Available",
    "drop log": "Drop Log Data Available",
    "changes header": "=== Update History ===",
    "fact": "[Citation Needed]",
    "members": "Members Only",
}

# The pieces of a pattern, and its text if there are none. {key} is a parameter, {key:t} its words with
# capitals, {key:c} its first 100 characters, {key#n} those of key1 to keyn.
PATTERN = {
    "recipe": (["Requires: {skill1lvl} {skill1:t}", "Requires: {skill2lvl} {skill2:t}", "Requires: {skill3lvl} {skill3:t}", "Materials: {mat#9}", "Creates: {output1}"], "[Recipe]"),
    "location line": (["Location: {name}", "Area: {location}", "Level: {levels}"], "[Location]"),
    "emote clue": (["Clue Tier: {tier:t}", "Emote: {emote}", "Location: {location}", "Required Items: {item#5}"], "[Emote Clue]"),
    "subject changes": (["Update Date: {date}", "Update: {update}", "Change: {change:c}"], "[Update History]"),
    "map": (["Map: {name}", "Coordinates: ({x}, {y})"], "[Map]"),
    "relative location": (["Location: {location}", "North: {north}", "South: {south}", "East: {east}", "West: {west}"], "[Relative Location]"),
    "thieving info": (["Thieving Target: {name}", "Required Level: {level}", "Experience: {xp}"], "[Thieving Info]"),
    "combat styles": (["Attack Speed: {speed}", "Attack Range: {attackrange}"], "[Combat Styles]"),
    "stash": (["STASH Location: ({x}, {y})", "Description: {text}"], "[STASH Unit Location]"),
    "spawn line": (["Item: {name}", "Location: {location}", "Members: {members}"], "Item Spawn"),
    "spawn bottom": (["Respawn Timer: {respawn timer}"], ""),
    "citation": (["[Twitter: @{user}]"], "[Citation]"),
    "fairy code": (["[Fairy Ring: {1}]"], "[Fairy Ring Code]"),
    "sherlock": (["Sherlock Challenge: {skill}"], "Sherlock Elite Clue Challenge"),
    "falo": (["Falo Item: {item}"], "Falo Master Clue Item"),
    "main article": (["Main Article: {1}"], "See Main Article"),
    "audio": (["Audio: {title}"], "Audio Available"),
    "drop value": (["Average Drop Value: {value}"], "Drop Value Calculated"),
    "coins": (["{1} coins"], "coins"),
    "skill link": (["Skill: {1}"], "Skill"),
    "boss": (["Boss: {1}"], "Boss"),
}

_COMMON = {"members": "Members Only", "release": "Release Date"}
# Labels of parameters by family, where they are not the key with capitals.
LABELS = {
    "infobox": _COMMON | {
        "combat": "Combat Level", "examine": "Examine Text", "att": "Attack Level", "str": "Strength Level", "def": "Defence Level", "mage": "Magic Level", "range": "Ranged Level",
        "attbns": "Attack Bonus", "strbns": "Strength Bonus", "amagic": "Magic Attack Bonus", "mbns": "Magic Damage Bonus", "arange": "Ranged Attack Bonus", "rngbns": "Ranged Strength Bonus",
        "dstab": "Stab Defence", "dslash": "Slash Defence", "dcrush": "Crush Defence", "dmagic": "Magic Defence", "dlight": "Light Ranged Defence", "dstandard": "Standard Ranged Defence",
        "dheavy": "Heavy Ranged Defence", "max hit": "Maximum Hit", "xpbonus": "XP Bonus", "slayxp": "Slayer XP", "cat": "Slayer Category", "assignedby": "Assigned By",
        "immunepoison": "Poison Immunity", "immunevenom": "Venom Immunity", "immunecannon": "Cannon Immunity", "immunethrall": "Thrall Immunity", "id": "NPC ID",
        "leagueregion": "League Region", "destroy": "Destroy Text", "quest": "Quest Item", "version1": "Form 1", "version2": "Form 2", "version3": "Form 3",
    },
    "quest": _COMMON | {
        "name": "Quest Name", "number": "Quest Number", "image": "Quest Image", "series": "Quest Series", "start": "Start Point", "startmap": "Start Map Location",
        "items": "Items Required", "kills": "Enemies to Defeat", "ironman": "Ironman Concerns", "leagueregion": "League Region",
    },
    "item": _COMMON | {
        "name": "Item Name", "image": "Item Image", "quest": "Quest Item", "examine": "Examine Text", "exchange": "Grand Exchange", "id": "Item ID", "leagueregion": "League Region",
        "destroy": "Destroy Text", "kept": "Kept on Death", "highalch": "High Alchemy Value", "lowalch": "Low Alchemy Value",
    },
    "bonuses": {
        "astab": "Stab Attack Bonus", "aslash": "Slash Attack Bonus", "acrush": "Crush Attack Bonus", "amagic": "Magic Attack Bonus", "arange": "Ranged Attack Bonus",
        "dstab": "Stab Defence Bonus", "dslash": "Slash Defence Bonus", "dcrush": "Crush Defence Bonus", "dmagic": "Magic Defence Bonus", "drange": "Ranged Defence Bonus",
        "str": "Strength Bonus", "rstr": "Ranged Strength Bonus", "mdmg": "Magic Damage Bonus", "prayer": "Prayer Bonus", "slot": "Equipment Slot", "speed": "Attack Speed", "range": "Attack Range",
    },
    "npc": _COMMON | {"name": "NPC Name", "image": "NPC Image", "quest": "Quest NPC", "examine": "Examine Text", "map": "Map Location", "id": "NPC ID", "leagueregion": "League Region"},
    "location": _COMMON | {"name": "Location Name", "image": "Location Image", "type": "Location Type", "leagueregion": "League Region"},
    "skill": _COMMON | {"name": "Skill Name", "image": "Skill Image", "type": "Skill Type", "table": "Training Table", "leagueregion": "League Region"},
    "quest details": {"start": "Start Point", "startmap": "Start Map Location", "items": "Items Required", "kills": "Enemies to Defeat", "ironman": "Ironman Concerns", "leagueregion": "League Region"},
    "drops line": {
        "name": "Item Name", "rarity": "Drop Rate", "raritynotes": "Drop Rate Notes", "rolls": "Rolls Per Kill", "gemw": "Grand Exchange", "leagueregion": "League Region", "members": "Members Only",
    },
    "combat stats": {
        "att": "Attack", "attack": "Attack", "str": "Strength", "strength": "Strength", "def": "Defence", "defence": "Defence", "range": "Ranged", "ranged": "Ranged",
        "mage": "Magic", "magic": "Magic", "prayer": "Prayer", "hitpoints": "Hitpoints", "hp": "Hitpoints", "combat": "Combat Level",
    },
    "generic": _COMMON | {f"{n}": f"Parameter {n}" for n in range(1, 6)} | {f"{k}": f"{k.upper()} Coordinate" for k in "xyz"} | {
        "id": "ID", "xp": "Experience", "url": "URL", "examine": "Examine Text", "destroy": "Destroy Text", "alch": "Alchemy Value", "store": "Store Price", "exchange": "Exchange Price",
        "combat": "Combat Level", "respawn": "Respawn Time",
    },
}
# Labels of an infobox that come with a number, "(Form n)" after them.
FORMS = {
    "examine": ("Examine Text", (1, 2, 3)), "dmagic": ("Magic Defence", (1, 2, 3)), "dlight": ("Light Ranged Defence", (1, 2, 3)), "dstandard": ("Standard Ranged Defence", (1, 2, 3)),
    "dheavy": ("Heavy Ranged Defence", (1, 2, 3)), "max hit": ("Maximum Hit", (2,)), "attack style": ("Attack Style", (1, 2, 3)), "id": ("NPC ID", (1, 2, 3)),
    "elementalweaknesstype": ("Elemental Weakness Type", (1, 2, 3)), "elementalweaknesspercent": ("Elemental Weakness Percent", (1, 2, 3)),
}
# What stands before, between and after a family's parameters, and what stands if there are none.
FRAMES = {
    "infobox": ("", "\n", "\n", None),
    "quest": ("=== Quest Information ===", "\n", "\n", None),
    "item": ("=== Item Information ===", "\n", "", None),
    "bonuses": ("=== Combat Bonuses ===", "\n", "\n", None),
    "npc": ("=== NPC Information ===", "\n", "", None),
    "location": ("=== Location Information ===", "\n", "", None),
    "skill": ("=== Skill Information ===", "\n", "", None),
    "quest details": ("=== Quest Details ===", "\n", "", None),
    "combat stats": ("Combat Stats: ", ", ", "", ""),
    "drops line": ("", " | ", "", "[Drop Entry]"),
    "diary stats": ("Skill Requirements: ", ", ", "", "Skill Requirements"),
    "generic": ("", ", ", "", None),
}
# Names of floors.
FLOORS = {"0": "Ground Floor", "1": "1st Floor", "2": "2nd Floor", "3": "3rd Floor"}


def value(params: Column, key: str) -> Column:
    """The value of a parameter, null if absent; the last of a repeated key."""
    found = F.filter(params, lambda p: p["key"] == key)
    return F.get(found, F.size(found) - 1)["value"]


def piece(params: Column, text: str) -> Column:
    """A pattern's piece with its parameters put in; null if one is absent."""
    out = []
    for lit, key, form, most in re.findall(r"([^{]*)(?:\{([^}:#]+)(?:([:#])(\w+))?\})?", text):
        out += [F.lit(lit)] if lit else []
        if form == "#":
            some = F.array_compact(F.array(*(value(params, f"{key}{k}") for k in range(1, int(most) + 1))))
            out.append(F.when(F.size(some) > 0, F.array_join(some, ", ")))
        elif key:
            v = value(params, key)
            cut = F.when(F.char_length(v) > 100, F.concat(F.substring(v, 1, 100), F.lit("..."))).otherwise(v)
            out.append({"t": F.initcap(v), "c": cut}.get(most, v))
    return F.concat(*out)


def title_case(t: Column) -> Column:
    """Every run of letters with a capital and small letters after it."""
    return F.array_join(F.transform(F.regexp_extract_all(t, F.lit(r"[\p{L}]+|[^\p{L}]+"), F.lit(0)), F.initcap), "")


def _first(params: Column) -> Column:
    """The first unnamed parameter that is not empty."""
    return F.nullif(value(params, "1"), F.lit(""))


def text_of(name: Column, fam: Column, params: Column) -> Column:
    """What a template of a family stands for; null for a family whose parameters are labelled."""
    has = lambda k: F.exists(params, lambda p: p["key"] == k)
    link = F.coalesce(_first(params), F.get(F.filter(params, lambda p: (p["value"] != "") & ~F.startswith(p["key"], F.lit("pic")) & ~p["key"].isin("txt", "name")), F.lit(0))["value"])
    shown = value(params, "txt")
    floor = value(params, "uk")
    note = F.coalesce(_first(params), F.get(F.filter(params, lambda p: F.char_length(p["value"]) > 3), F.lit(0))["value"])
    skill, level = (F.get(params, F.lit(k))["value"] for k in (0, 1))
    skill, level = (F.coalesce(value(params, "1"), skill), F.coalesce(value(params, "2"), level))
    level_word = F.when(F.lower(skill).isin("combat", "quest"), ": ").otherwise(" Level: ")
    own = {
        "boostable": F.when((F.coalesce(value(params, "1"), F.lit("")) == "yes") | (F.coalesce(value(params, "yes"), F.lit("")) != ""), "[Boostable]").otherwise("[Not Boostable]"),
        "quest start": F.when(has("yes") | has("1"), "(Required to Start)").otherwise(""),
        "transcript": F.when(F.exists(params, lambda p: F.contains(F.lower(p["key"]), F.lit("npc"))), "[NPC Dialogue Available]").otherwise("[Transcript Available]"),
        "floor": F.coalesce(F.element_at(F.create_map(*(F.lit(v) for kv in FLOORS.items() for v in kv)), floor), F.concat(floor, F.lit("th Floor")), F.lit("[Floor]")),
        "page link": F.coalesce(F.when(shown != link, F.concat(F.lit("[["), link, F.lit("|"), shown, F.lit("]]"))), F.concat(F.lit("[["), link, F.lit("]]")), F.lit("[Link]")),
        "footnote": F.coalesce(F.concat(F.lit("[Note: "), note, F.lit("]")), F.lit("[Footnote]")),
        "redirect": F.coalesce(F.concat(F.lit("[See: "), _first(params), F.lit("]")), F.lit("[Redirect]")),
        "respell": F.coalesce(F.when(has("1"), F.concat(F.lit("Also known as: "), value(params, "2"))), F.lit("")),
        "skill level": F.coalesce(F.concat(F.when(F.lower(skill) == "quest", "Quest Points").otherwise(F.initcap(skill)), level_word, level), F.lit("Skill Requirement")),
        "equipment category": F.concat(F.lit("=== "), F.initcap(F.replace(name, F.lit("_"), F.lit(" "))), F.lit(" ===")),
    }
    for k, (pieces, none) in PATTERN.items():
        some = F.array_compact(F.array(*(piece(params, p) for p in pieces)))
        own[k] = F.when(F.size(some) > 0, F.array_join(some, " | ")).otherwise(none)
    own |= {k: F.lit(v) for k, v in CONSTANT.items()}
    out = F.lit(None).cast("string")
    for k, v in own.items():
        out = F.when(fam == k, v).otherwise(out)
    return out


# Rules that make rendered text readable, in order, as (pattern, replacement with $n).
READABLE = [
    (r"\[\[([^|\]]+)\|([^\]]+)\]\]", "$2"),
    (r"\[\[([^\]]+)\]\]", "$1"),
    (r"'''([^']+)'''", "$1"),
    (r"''([^']+)''", "$1"),
    (r"==+\s*([^=]+)\s*==+", "\n=== $1 ===\n"),
    (r"(===\s*[^=]+\s*===)([A-Z])", "$1\n$2"),
    (r"(\|[^|]+\|[^|]+\|[^|]+)", "$1\n"),
    (r"([a-z]:)\s*([0-9]+)([A-Z])", "$1 $2\n$3"),
    (r"\n\s*\n\s*\n+", "\n\n"),
    (r" +", " "),
    (r"(?m)^\s+|\s+$", ""),
    (r"\{\{[^}]*\}\}", ""),
    (r"<[^>]+>", ""),
    (r"([.!?])\s*([A-Z])", "$1 $2"),
    (r"([a-z])([A-Z])", "$1 $2"),
]
_SIDE = "(left|right|center)"
# Rules against what raw wikitext leaves behind, in order.
LEFT_BEHIND = [
    (r"\[\[([^|\]]+)\|([^\]]+)\]\]", "$2"),
    (r"\[\[([^|\]]+)\|?\]\]", "$1"),
    (r"\[https?://[^\s\]]+\s*([^\]]*)\]", "$1"),
    (r"(?mi)^\s*(Alt\s*image\d*|Image\d*|Item Image|Location Image|NPC Image)\s*:.*$", ""),
    (rf"(?mi)^\s*{_SIDE}\s*(\|\s*)?(\d+px)?\s*$", ""),
    (rf"(?mi)^\s*\d+px\s*\|\s*{_SIDE}\s*$", ""),
    (r"(?mi)^\s*\d+\s*:\s*x?\d+px\s*$", ""),
    (r"(?i)\d+\s*:\s*x?\d+px\b", ""),
    (rf"(?i)\b\d+px\b\s*\|\s*{_SIDE}\b", ""),
    (r"(?m)^\s*\d+\s*:\s*$", ""),
    (r"(?mi)^\s*thumb\|.*$", ""),
    (r"(?mi)(^|\s)frame\|", "$1"),
    (r"(?mi)^\s*\[\s*show\s*\].*$", ""),
    (r"(?mi)^\s*v\s*•\s*(?:d\s*•\s*)?e\b.*$", ""),
    (r"(?m)^\s*(?:•\s*){8,}.*$", ""),
    (r"(?s)<!--.*?-->", ""),
    (r"\{\{\s*\}\}", ""),
    (r"\{\{[^}]*$", ""),
    (r"^[^{]*\}\}", ""),
    (r"\n\s*\n\s*\n", "\n\n"),
    (r"(?m)^\s+|\s+$", ""),
]
