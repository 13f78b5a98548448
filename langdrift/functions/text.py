"""Text and scalar functions as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: English function words.
FUNCTION_WORDS = (
    "a about above after again against all also am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further "
    "had has have having he her here hers herself him himself his how i if in into is it its itself just may me might more most must my myself no nor not now of off on once only or other our ours "
    "ourselves out over own same shall she should so some such than that the their theirs them themselves then there these they this those through to too under until up upon us very was we were what "
    "when where which while who whom whose why will with would you your yours yourself yourselves"
).split()


@F.pandas_udf(StringType())
def _nfkd(texts):
    return texts.map(lambda t: unicodedata.normalize("NFKD", t), na_action="ignore")


def nfkd(text: Column) -> Column:
    """Compatibility decomposition; only texts with other than ASCII characters go to Python, nulls stand for the others."""
    return F.coalesce(_nfkd(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def clean_text(text: Column, decompose: bool = True) -> Column:
    """Lower case, trimmed, numbers as NUMBER, a space after punctuation before a word, decomposed, single spaces."""
    t = F.regexp_replace(F.lower(text), r"(?U)^\s+|\s+$", "")
    t = F.regexp_replace(t, r"\p{Nd}+(\.\p{Nd}+)*", "NUMBER")
    t = F.replace(t, F.lit("\n"), F.lit(" "))
    t = F.regexp_replace(t, r"([.,!?:;]+)(?=[\p{L}\p{N}_])", "$1 ")
    t = nfkd(t) if decompose else t
    return F.regexp_replace(t, r" +", " ")


#: A word (letters, their marks and digits) with a trailing hyphen, or one other character.
TOKEN = r"[\p{L}\p{M}\p{N}_]+-?|[^\s\p{L}\p{M}\p{N}_]"


def tokenise(text: Column, decompose: bool = True) -> Column:
    """Tokens of the cleaned text, in which every run of punctuation, single marks too, is its first mark and a space."""
    t = F.regexp_replace(clean_text(text, decompose), r"(\p{P})\p{P}*", "$1 ")
    return F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0))


def truncate(tokens: Column, n: int) -> Column:
    return F.slice(tokens, 1, n)


#: Pad symbol before and after a text; a value, so that joins match it.
PAD = "\u0002"


def bigrams(tokens: Column) -> Column:
    """Padded bigrams as structs w1, w2; an empty text has one."""
    pad = F.array(F.lit(PAD))
    return F.arrays_zip(F.concat(pad, tokens).alias("w1"), F.concat(tokens, pad).alias("w2"))


def ngrams(tokens: Column, n: int) -> Column:
    """n-grams as space-separated strings; none if there are fewer tokens."""
    grams = F.transform(F.sequence(F.lit(0), F.size(tokens) - n), lambda i: F.array_join(F.slice(tokens, i + 1, n), " "))
    return F.when(F.size(tokens) >= n, grams).otherwise(F.array().cast("array<string>"))


def pos_sequence(tagged: Column) -> Column:
    """Parts of speech of an array of {tok, lemma, pos}."""
    return F.transform(tagged, lambda t: t["pos"])


def is_content_token(token: Column, function_words: list[str] = FUNCTION_WORDS) -> Column:
    """Not starting with punctuation, symbol or number, and no function word."""
    return ~token.rlike(r"^[\p{P}\p{S}\p{N}]") & ~token.isin(list(function_words)) & (token != "")


def mention_pattern(terms: list[str]) -> str:
    """One pattern for any of the regular-expression terms."""
    return "|".join(f"(?:{t})" for t in terms)


def topic_flag(text: Column, section: Column, mention_terms: list[str], section_terms: list[str], mode: str = "both") -> Column:
    """Whether a row is on the topic: by mention, by section, by either (``both``), or always (``none``)."""
    mentions = F.coalesce(F.lower(text).rlike(mention_pattern(mention_terms)), F.lit(False))
    sections = F.coalesce(F.lower(section).rlike(mention_pattern(section_terms)), F.lit(False))
    modes = {"both": mentions | sections, "mentions": mentions, "sections": sections, "none": F.lit(True)}
    return modes.get(mode.lower(), mentions | sections)


#: The titles, of which a name may lose one.
TITLES = r"^(?:[mM]rs?|[mM]s|[dD]ame|[sS]ir|[bB]aron(?:ess)?|[lL]ord|[lL]ady|[dD]r) "


def display_name(name: Column) -> Column:
    """A name without the title it begins with; a second one, or one that isn't listed, stays."""
    return F.regexp_replace(name, TITLES, "")


def is_single_word(name: Column) -> Column:
    """Whether a name doesn't begin with two words, as where a title was all that stood before a surname."""
    return ~name.rlike(r"^\S+ \S")


def clean_vote(vote: Column) -> Column:
    """aye, no or did-not-vote."""
    return F.when(vote.contains("Aye"), "aye").when(vote.contains("No"), "no").otherwise("did-not-vote")


def clean_stance(stance: Column) -> Column:
    """leave, remain or unknown."""
    s = F.lower(F.trim(stance))
    return F.when(s.isin("leave", "remain"), s).otherwise("unknown")


def lean(leave_percent: Column) -> Column:
    """remain below 50 per cent, else leave; null stays null."""
    return F.when(leave_percent < 50, "remain").when(leave_percent >= 50, "leave")


def lean_label(leave_percent: Column) -> Column:
    """Leave (52.3%): the lean with the figure of its side."""
    share = F.when(leave_percent < 50, 100 - leave_percent).otherwise(leave_percent)
    return F.concat(F.initcap(lean(leave_percent)), F.lit(" ("), F.format_number(share, 1), F.lit("%)"))


DATE_FORMATS = {"long": "d MMMM yyyy", "slashes": "dd/MM/yyyy", "dashes": "dd-MM-yyyy", "stamp": "yyyy-MM-dd HH:mm:ss", "iso": "yyyy-MM-dd"}


def parse_date(text: Column, kind: str = "iso") -> Column:
    """A date; null if the text isn't one."""
    return F.to_date(F.try_to_timestamp(text, F.lit(DATE_FORMATS[kind])))


def month_floor(date: Column) -> Column:
    return F.trunc(date, "month").cast("date")


def debate_file_parts(name: Column) -> Column:
    """{id, number} of a file name like ``12-CHAN34.xml``; null fields where it is none."""
    part = lambda i: F.when(name.rlike(r"^[0-9]+-CHAN[0-9]+"), F.regexp_extract(name, r"^([0-9]+)-CHAN([0-9]+)", i)).cast("long")
    return F.struct(part(1).alias("id"), part(2).alias("number"))
