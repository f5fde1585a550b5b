"""Host names, certificate names and other text forms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hostname(name: Column) -> Column:
    """In lower case without dots and spaces at the ends and one NUL at the end; null if nothing useful is left."""
    bare = F.regexp_replace(name, r"^[. ]+|[. ]+$", "")
    bare = F.regexp_replace(bare, r"\x00\z", "")
    return F.when((bare != "") & (bare != "*") & ~bare.rlike(r"[ \t]"), F.lower(bare))


def best_hostname(names: Column) -> Column:
    """Of sorted names, the first that doesn't end in .local, else the first; '' for none."""
    plain = F.filter(names, lambda n: ~n.endswith(".local"))
    return F.coalesce(F.get(plain, F.lit(0)), F.get(names, F.lit(0)), F.lit(""))


def common_name(subject: Column) -> Column:
    """What follows CN= in the first comma part that starts with it; '' for none."""
    parts = F.filter(F.transform(F.split(subject, ","), lambda p: F.trim(p)), lambda p: F.upper(F.substring(p, 1, 3)) == "CN=")
    return F.coalesce(F.substring(F.get(parts, F.lit(0)), 4, 1_000_000), F.lit(""))


def first_word(text: Column) -> Column:
    """Up to the first space, tab, comma or semicolon that isn't at the start."""
    return F.when(text.rlike(r"^[ \t,;]"), text).otherwise(F.regexp_extract(text, r"^([^ \t,;]*)", 1))


def clean_vendor(name: Column) -> Column:
    """An organisation's name without its legal forms, however many stand at its end; '' for what is then no name."""
    text = F.trim(F.regexp_replace(name, r"\s+", " "))
    form = rf"(?<=[ ,])(?:{'|'.join(f.replace('.', r'[.]') for f in LEGAL_FORMS)})"
    bare = F.regexp_replace(text, rf"(?i)[ ,.\-]*(?:{form}[ ,.\-]+)*{form}$", "")
    bare = F.regexp_replace(bare, r"[ ,.\-]+$", "")
    return F.when((F.lower(text) == "private") | (F.length(bare) < 2), F.lit("")).otherwise(bare)


#: Endings of organisations' names that are dropped, the first that fits at a time.
LEGAL_FORMS = (
    "co., ltd.", "co.,ltd.", "co., ltd", "co.,ltd", "co ltd", "co., limited",
    "company limited", "company, ltd.", "corporation", "incorporated",
    "limited", "gmbh & co. kg", "gmbh", "co., inc.", "co.,inc.",
    "inc.", "inc", "llc.", "llc", "ltd.", "ltd", "l.t.d.",
    "corp.", "corp", "s.a.", "s.a", "b.v.", "bv", "n.v.", "nv",
    "a/s", "aps", "ab", "oy", "as", "sas", "sarl", "s.r.l.", "srl",
    "spa", "s.p.a.", "plc", "pty", "pte", "pvt", "co.", "company",
    "technology co", "technologies co",
)
