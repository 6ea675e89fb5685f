"""Lexicons are ordinary inputs: YAML files of users, or the demonstration lexicons below.

The demonstration lexicons suit the invented travelogues of the test tables; every operator takes
its lexicon as an argument.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: R classes: words by which a passage is read as negative, exotic or positive.
REPRESENTATION = {
    "negative": ["wretched", "gloomy", "sour", "bitter", "crooked", "shabby", "muddy", "leaky", "smoky", "mouldy"],
    "exotic": ["curious", "ancient", "splendid", "painted", "fragrant", "distant", "lonely", "obscure", "wretched"],
    "positive": ["friendly", "cheerful", "tidy", "proud", "modest", "fertile", "bright", "patient", "polished"],
}
#: O domains: markers of the situation; a marker listed twice counts twice.
SITUATION = {
    "trade": ["sold", "bought", "loads", "roubles", "kopeks", "bags", "price", "sold"],
    "travel": ["road", "river", "ferry", "boat", "bridge", "versts", "crossed", "caravan"],
    "dwelling": ["hut", "kitchen", "stove", "oven", "tent", "cabin", "roofless"],
    "labour": ["repaired", "mended", "built", "carried", "hauled", "carpenters", "dyers", "crossed"],
}
VERBS = {
    "fight": ["plundered", "burned", "abandoned", "avoided"],
    "trade": ["sold", "bought", "exchanged", "purchased"],
    "help": ["protected", "guarded", "followed", "rested"],
}
#: Misread forms and what they stand for, applied one after another.
REPLACEMENTS = [("tbe", "the"), ("aud", "and"), ("bcfore", "before"), ("tbat", "that"), ("wcre", "were"), ("havc", "have")]

# Word lists that the operators' definitions name.
STOP_NOISE = """a an the and or but in on at to for of with by from as is was are were been be have has had do does did will would could
should may might must can this that these those it its they them we our i you he she his her their my your""".split()
STOP_KEYNESS = [*STOP_NOISE, "not", "no", "so", "if", "than"]
HEADER_WORDS = "chapter part book section volume page contents index the".split()
EPITHET_STOP = """other many several some such great little first last few one two three next same different certain various numerous
most more less much all both either neither no any every each very quite rather almost enough too""".split()
EXOTIC_MARKERS = """strange curious peculiar primitive savage wild picturesque oriental exotic quaint unusual remarkable singular odd
fantastic mysterious romantic colourful colorful striking""".split()
PITFALLS = "savage primitive simple childlike barbarous backward uncivilized superstitious filthy lazy cunning cruel wild".split()
LANDSCAPE = """steppe taiga forest tundra wilderness barren desolate vast endless river snow frost savage bleak remote primitive wild
mountain ice cold dreary uncultivated""".split()


def load_yaml(path: str | Path) -> dict:
    """A YAML lexicon: category -> words (or wrong -> right); an empty file is an empty lexicon."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def as_frame(spark: SparkSession, lexicon: dict[str, list[str]], key: str = "category", value: str = "term") -> DataFrame:
    """One row per category and term, repeats kept, terms in small letters."""
    rows = [(k, str(w).strip().lower()) for k, words in lexicon.items() for w in words]
    return spark.createDataFrame(rows, f"{key} string, {value} string")


def known_words(*lexicons: dict[str, list[str]], targets: list[tuple[str, str]] = ()) -> set[str]:
    """All words of several lexicons and the right sides of the replacements."""
    return {w.lower() for x in lexicons for words in x.values() for w in words} | {r.lower() for _, r in targets}
