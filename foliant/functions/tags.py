"""Classes, normal forms and predicates of user tags, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of tags that say nothing of a book's content, found anywhere in the tag; the first class wins.
STATUS = "to.?read want.?to.?read wtr wishlist currently.?reading cr reading.?now read finished done dnf did.?not.?finish abandoned".split()
FORMATS = "hardcover hc paperback pb ebook kindle audiobook audio pdf epub".split()
SOURCES = "amazon library borrowed owned purchased gift free arc netgalley".split()
PERSONAL = "favorites? favs? best top worst owned collection shelf bookshelf".split()

#: Words without theme, affixes that go, tags that stay as they are.
GENERIC = "book books novel novels fiction story stories".split()
SUFFIXES = "-books -novels -fiction -story -stories".split()
PREFIXES = "books- novels- fiction- story-".split()
KEPT = "to-read currently-reading want-to-read wtr tbr".split()

#: The classes of the rule classifier and what a tag of theirs contains, after hyphens and underscores have become
#: spaces; words that hold another of the same class, or a hyphen, can't decide and aren't listed.
RULES = {
    "HEROINE_ARCHETYPE": ["heroine"],
    "HERO_ARCHETYPE": [" hero", "alpha male", "bad boy", "billionaire", "rockstar"],
    "PAIRING_TYPE": ["mm", "m m", "ff", "f f", "mf", "m f", "menage", "ménage", "polyamory"],
    "STATUS_INTENT": ["to read", "tbr", "currently reading", "read 201", "dnf", "did not finish", "didn t finish", "couldn t finish", "abandoned", "on hold", "up next", "read soon", "queued", "reread"],
    "OWNERSHIP_SOURCE": ["owned", "books i own", "my books", "have but not read", "freebie", "free read", "library", "netgalley", "arc", "edelweiss", "hoopla", "scribd", "giveaway", "signed"],
    "FORMAT_MEDIUM": ["ebook", "e books", "digital", "pdf", "epub", "kindle", "kobo", "nook", "ibook", "ipad", "audiobook", "audio ", "paperback"],
    "GENRE": ["romance", "fantasy", "mystery", "thriller", "suspense", "crime", "horror", "scifi", "historical", "women s fiction", "inspirational", "ya ", " teen", "children"],
    "PLOT_THEME": ["pregnancy", "kidnapping", "kidnapped", "abuse", "rape", "disability", "revenge", "betrayal", "mafia", "secrets", "bikers", "sport", "athlete", "rockstar", "musician"],
    "SETTING_WORLD": ["regency", "victorian", "historicals", "western", "england", "british", "christmas", "holiday", "war", "college", "vampire", "vamps", "werewolf", "wolves", "shifter", "dragons", "fae", "angels", "demons", "alien", "ghosts"],
    "TONE_CONTENT": ["erotic", "smut", "steamy", "clean ", "bdsm", "kink", "dark ", "angst", "heartbreaking", "fun", "humor", "humour", "hilarious", "intense"],
    "EVALUATION": ["fav", "loved", "meh", "boring", "nope"],
    "SERIES_STRUCTURE": ["series", "standalone", "trilogy"],
    "ORG_META": ["botb", " release", " default", " other ", " history"],
}
OTHER = "UNKNOWN_OTHER"

#: Keyword clusters, matched as whole words or before a hyphen or underscore; the first hit wins.
CLUSTERS = {
    "noncontent": {
        "reading_status": "to-read currently-reading read finished dnf tbr wtr", "format": "ebook kindle audiobook hardcover paperback pdf epub",
        "year": "read-2012 read-2013 read-2014 2012-reads 2013-reads", "ownership": "owned library borrowed wishlist i-own",
    },
    "emotion": {
        "funny_humorous": "funny humor humour humorous hilarious comedy comedic laugh laughing witty", "sad_emotional": "sad sadness emotional tear tears cry crying cried heartbreak heartbreaking heart-wrenching tragic",
        "sweet_romantic": "sweet sweetheart sweetie cute adorable fluffy feel-good heartwarming", "angry_intense": "angry rage furious intense intensity passionate", "happy_joyful": "happy joy joyful cheerful uplifting inspiring",
    },
    "trope": {
        "forced_arranged_marriage": "forced-marriage forced-marry arranged-marriage arranged-marry marriage-of-convenience moc unwilling-wife forced-wife",
        "enemies_to_lovers": "enemies-to-lovers enemies-to-lover enemy-to-lover hate-to-love hate-to-lovers", "friends_to_lovers": "friends-to-lovers friends-to-lover friend-to-lover best-friends",
        "second_chance": "second-chance second-chances reunion reunited", "virgin_heroine": "virgin virgin-heroine virgin-hero first-time innocent", "alpha_male": "alpha alpha-male alpha-hero possessive dominant alpha-does-not-share",
        "billionaire": "billionaire billionaires rich wealthy millionaire", "mafia_crime": "mafia mafioso crime criminal gangster mob", "small_town": "small-town smalltown small-town-romance",
        "fake_relationship": "fake-relationship fake-dating pretend pretend-relationship", "age_gap": "age-gap older-man younger-woman older-woman younger-man", "single_parent": "single-parent single-mom single-dad single-mother single-father",
        "pregnancy": "pregnancy pregnant baby babies expecting", "amnesia": "amnesia memory-loss forgot", "secret_baby": "secret-baby secret-child hidden-baby", "love_triangle": "love-triangle triangle love-square",
        "reverse_harem": "reverse-harem rh why-choose multiple-partners", "fated_mates": "fated-mates fated mate soulmate destined",
    },
    "genre_heat": {
        "erotica": "erotica erotic erotic-romance", "hot_steamy": "hot steamy steam sizzling scorching sultry", "explicit": "explicit explicit-content graphic graphic-sex", "spicy": "spicy spice heat heated",
        "sweet_clean": "clean sweet-romance clean-romance innocent chaste kisses-only", "closed_door": "closed-door fade-to-black ftb",
    },
    "genre": {
        "contemporary": "contemporary contemporary-romance modern", "historical": "historical historical-romance regency victorian medieval", "paranormal": "paranormal paranormal-romance supernatural vampire werewolf shifter magic",
        "fantasy": "fantasy fantasy-romance epic-fantasy", "sci_fi": "sci-fi science-fiction sf futuristic space", "suspense_thriller": "suspense thriller mystery romantic-suspense", "western": "western cowboy ranch rodeo",
        "sports": "sports sport athlete football hockey baseball", "military": "military navy army marine soldier veteran", "mc_motorcycle": "mc motorcycle biker club",
    },
}


def noncontent_class(c: Column, anchored: bool = False) -> Column:
    """The class of a tag that says nothing of content, null for others. Patterns are found anywhere in the tag unless anchored."""
    s = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    any_of = lambda patterns: s.rlike(rf"^(?:{'|'.join(patterns)})$" if anchored else "|".join(patterns))
    rules = [
        (F.length(s) <= 1, "generic_noncontent"), (s.rlike(r"^\d+$"), "ratings_valence"), (s.rlike(r"^\d+[*★☆]+$|^[*★☆]+\d*$"), "ratings_valence"), (any_of(STATUS), "process_status"),
        (s.rlike(r"\d{4}"), "dates_campaigns"), (any_of(FORMATS), "format_edition"), (any_of(SOURCES), "source_acquisition"), (any_of(PERSONAL), "personal_org"),
    ]
    return F.coalesce(*(F.when(hit, name) for hit, name in rules))


def camel_parts(c: Column) -> Column:
    """Runs of letters by case and of digits, in order; the tag itself where there is none."""
    parts = F.regexp_extract_all(c, F.lit(r"([A-Z]?[a-z]+|[A-Z]+(?=[A-Z]|$)|\d+)"), F.lit(1))
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(c))


def singular_candidate(c: Column) -> Column:
    """What a plural's singular would be: -ies to -y, else without -es, else without -s; null for short and other tags."""
    n = F.length(c)
    cut = lambda k: c.substr(F.lit(1), n - k)
    return F.when(n > 3, F.when(c.endswith("ies") & (n > 4), F.concat(cut(3), F.lit("y"))).when(c.endswith("es") & (n > 4), cut(2)).when(c.endswith("s"), cut(1)))


def without_generic(c: Column) -> Column:
    """Without words that say nothing, between spaces, else between hyphens; the tag itself where too little would be left."""
    words, parts = F.filter(F.split(F.trim(c), r"\s+"), lambda x: x != ""), F.split(c, "-")
    kept = lambda x: F.filter(x, lambda w: ~w.isin(GENERIC))
    spaced, joined = F.array_join(kept(words), " "), F.regexp_replace(F.array_join(kept(parts), "-"), "^-+|-+$", "")
    return F.when((F.size(words) > 1) & (spaced != "") & (spaced != c), spaced).when((F.size(parts) > 1) & (F.length(joined) > 2) & (joined != c), joined).otherwise(c)


def without_affixes(c: Column) -> Column:
    """Without a generic suffix, then without a generic prefix, where more than two characters are left."""

    def strip(x: Column, affix: str, front: bool) -> Column:
        rest = x.substr(F.lit(len(affix) + 1), F.length(x)) if front else x.substr(F.lit(1), F.length(x) - len(affix))
        rest = F.trim(F.regexp_replace(rest, "^-+|-+$", ""))
        return F.when((F.startswith(x, F.lit(affix)) if front else x.endswith(affix)) & (F.length(rest) > 2) & ~rest.isin(KEPT), rest)

    back = F.coalesce(*(strip(c, a, False) for a in SUFFIXES), c)
    both = F.coalesce(*(strip(back, a, True) for a in PREFIXES), back)
    return F.when(c.isin(KEPT) | (F.length(both) < 2), c).otherwise(both)


def keyword_pattern(words: str) -> str:
    either = "|".join(re.escape(w) for w in words.split())
    return rf"\b(?:{either})\b|(?:{either})[-_]"


def cluster(c: Column, clusters: dict[str, dict[str, str]] | None = None) -> Column:
    """struct(cluster_type, cluster_name) of the first cluster whose keyword the tag holds; unclustered without one."""
    s = F.lower(c)
    name = lambda kind, n: F.struct(F.lit(kind).alias("cluster_type"), F.lit(n).alias("cluster_name"))
    hits = [F.when(s.rlike(keyword_pattern(w)), name(kind, n)) for kind, own in (clusters or CLUSTERS).items() for n, w in own.items()]
    return F.coalesce(*hits, name("unclustered", "unclustered"))


def spaced(c: Column) -> Column:
    """Lower case, hyphens and underscores as spaces, squeezed. Null: ''."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[-_\s]+", " "))


def contains_any(c: Column, words: list[str]) -> Column:
    return c.rlike("|".join(re.escape(w) for w in words))


def rule_class(c: Column, rules: dict[str, list[str]] | None = None) -> Column:
    """The first class of which the tag holds a word, anywhere; UNKNOWN_OTHER for others, null and blank."""
    s = spaced(c)
    return F.coalesce(*(F.when(contains_any(s, w), k) for k, w in (rules or RULES).items()), F.lit(OTHER))


def is_dash_heavy(c: Column) -> Column:
    """Opens with a hyphen or underscore, or has at least three of them and half its length."""
    dashes = F.regexp_count(c, F.lit("[-_]"))
    return c.rlike(r"^[-_]") | (dashes >= F.greatest(F.lit(3), F.floor(F.length(c) / 2)))


#: Two-letter Unicode categories whose characters character_profile() counts.
CATEGORIES = "Lu Ll Lt Lm Lo Mn Mc Me Nd Nl No Pc Pd Ps Pe Pi Pf Po Sm Sc Sk So Zs Zl Zp Cc Cf Cs Co".split()


def character_profile(c: Column) -> Column:
    """A map of a text's Unicode categories to how often they occur in it."""
    counts = F.array(*(F.struct(F.lit(k).alias("key"), F.regexp_count(c, F.lit(rf"\p{{{k}}}")).alias("value")) for k in CATEGORIES))
    return F.map_from_entries(F.filter(counts, lambda x: x.value > 0))


def is_bad_token(c: Column) -> Column:
    """More than half digits, or more than half punctuation."""
    n = F.greatest(F.length(c), F.lit(1))
    return (F.regexp_count(c, F.lit(r"\p{Nd}")) / n > 0.5) | (F.regexp_count(c, F.lit(r"\p{P}")) / n > 0.5)
