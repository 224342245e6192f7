"""Content words of titles, and what kind of change a rewrite is, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing about a story, suffixes that are cut, endings that keep a word whole.
STOP = """
    a about above after again against all also am an and any are as at be because been before being below between both but by can could did do does
    doing down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me
    more most my no nor not now of off on once only or other our ours out over own same she should so some such than that the their them then there
    these they this those through to too under until up very was we were what when where which while who whom why will with would you your yours
    says say said new news live latest update updates first last one two three after over get gets got make makes made may might must amid via year years
    day days week weeks time back people man woman men women told tell video watch read more breaking email app podcast follow sign newsletter daily morning
""".split()
SUFFIXES = "ings ing edly ed es s e".split()
LEAST = 4  # letters that a cut leaves
LABEL = r"^\s*[A-Za-z][\p{L}\p{N}_ ]{0,20}?\s*[:|–—]\s+"
FIGURES = r"[0-9]+(?:[.,][0-9]+)*"
KINDS = ("numbers", "label", "reworded", "new angle")
NEW_ANGLE, NUMBERS = 0.25, 0.7



def stem(word: Column) -> Column:
    """The first suffix in order that leaves enough letters is cut; figures and some endings keep a word whole."""
    out = word
    for suffix in reversed(SUFFIXES):
        n = len(suffix)
        out = F.when(F.endswith(word, F.lit(suffix)) & (F.length(word) >= LEAST + n), F.left(word, F.length(word) - n)).otherwise(out)
    return F.when(word.rlike("^[0-9]+$|(ss|us|is)$"), word).otherwise(out)


def written_words(text: Column) -> Column:
    """Words as written in lower case, inner apostrophes and possessives gone."""
    raw = F.regexp_extract_all(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit(r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*"), F.lit(0))
    return F.transform(raw, lambda w: F.regexp_replace(F.regexp_replace(w, "['’]s$", ""), "['’]", ""))


def tokens(text: Column) -> Column:
    """Stems of the content words in order."""
    keeps = lambda w: ~w.isin(STOP) & ((F.length(w) >= 3) | w.rlike("[0-9]"))
    return F.filter(F.transform(written_words(text), stem), keeps)


def without_label(title: Column) -> Column:
    return F.trim(F.regexp_replace(title, LABEL, ""))


def rewrite_kind(old: Column, new: Column) -> Column:
    """numbers, label, reworded or new angle."""
    roots = lambda t: F.array_distinct(F.transform(F.filter(tokens(t), lambda w: ~w.rlike("^[0-9]+$")), lambda w: F.left(w, F.lit(5))))
    a, b = roots(old), roots(new)
    union = F.size(F.array_union(a, b))
    overlap = F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(1.0)
    bare_old, bare_new = without_label(old), without_label(new)
    labelled = ((bare_old != F.trim(old)) | (bare_new != F.trim(new))) & ((F.lower(bare_old) == F.lower(F.trim(new))) | (F.lower(bare_new) == F.lower(F.trim(old))))
    figures = lambda t: F.regexp_extract_all(t, F.lit(FIGURES), F.lit(0))
    return F.when(labelled, "label").when((figures(old) != figures(new)) & (overlap >= NUMBERS), "numbers").when(overlap < NEW_ANGLE, "new angle").otherwise("reworded")
