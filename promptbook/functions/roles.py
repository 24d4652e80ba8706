"""Reading a printed list of roles: names in capitals with descriptions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from promptbook.functions.text import WS, clip, strip

#: What counts as a word of a name, and what looks like a name but is none.
NAME_WORD = r"[A-Za-z]*[A-Z]{3,}[A-Za-z'.\-]*"
NUMERAL = "[IVXLCM]+"
HEADINGS = ("ACT", "SCENE", "PAGE")
#: Longest description that is kept whole.
DESCRIPTION_CHARS = 400

_LETTER = r"[\p{L}\p{N}_]"
#: A place between a word character and none, with Python's notion of word characters.
_EDGE = f"(?:(?<={_LETTER})(?!{_LETTER})|(?<!{_LETTER})(?={_LETTER}))"
NAME = f"{_EDGE}{NAME_WORD}(?:{WS}{NAME_WORD})*{_EDGE}"


def parse_roles(text: Column | str) -> Column:
    """``ARRAY<STRUCT<name, description>>`` of the roles in printed order.

    The names split the text, so what follows a name up to the next one, numerals and headings included, is its
    description. Null and texts without a name in capitals give an empty array.
    """
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    names = F.regexp_extract_all(text, F.lit(f"({NAME})"), 1)
    after = F.slice(F.split(text, NAME), 2, 2**30)  # one part for each name
    about = lambda part: clip(strip(F.regexp_replace(strip(part), "^[,;]+", "")), DESCRIPTION_CHARS)
    every = F.zip_with(names, after, lambda name, part: F.struct(name.alias("name"), about(part).alias("description")))
    bare = lambda role: F.replace(role["name"], F.lit(" "), F.lit(""))
    return F.filter(every, lambda role: ~bare(role).rlike(f"^{NUMERAL}$") & ~bare(role).isin(*HEADINGS))
