"""Structure of short texts: runs of letters, digits and separators, sizes, ratios and elevations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The separators inside codes, and the sizes that a nominal diameter can have.
SEPARATORS = "-/._:+ "
LEAST_SIZE, MOST_SIZE = 10, 3000
RUNS = r"(\p{L}+|\p{Nd}+|[-/._:+ ]|[^\p{L}\p{Nd}\-/._:+ ])"


def kind(run: Column) -> Column:
    """L, D, S or O of a run."""
    return F.when(run.rlike(r"^\p{L}"), "L").when(run.rlike(r"^\p{Nd}"), "D").when(run.rlike(r"^[-/._:+ ]"), "S").otherwise("O")


def runs(text: Column) -> Column:
    """The runs of a text as (kind, run)."""
    return F.transform(F.regexp_extract_all(text, F.lit(RUNS), F.lit(1)), lambda r: F.struct(kind(r).alias("kind"), r.alias("run")))


def pattern(text: Column) -> Column:
    """Kinds and lengths of runs, such as L1D1S1D3."""
    return F.array_join(F.transform(runs(text), lambda r: F.concat(r.kind, F.length(r.run).cast("string"))), "")


def counts(text: Column) -> Column:
    """How many runs of each kind, and flags made from them."""
    r = runs(text)
    of = lambda k: F.size(F.filter(r, lambda x: x.kind == k))
    return F.struct(
        of("L").alias("alpha"), of("D").alias("digit"), of("S").alias("separator"), of("O").alias("other"), F.size(r).alias("runs"),
        ((of("L") > 0) & (of("D") > 0)).alias("mixed"), (text == F.upper(text)).alias("upper"), (~text.contains(" ")).alias("compact"),
    )


def code_like(text: Column) -> Column:
    """Two runs of letters or digits or more, a separator that isn't blank, and a run of digits."""
    r = runs(text)
    words = F.size(F.filter(r, lambda x: x.kind.isin("L", "D")))
    return (words >= 2) & F.exists(r, lambda x: (x.kind == "S") & (x.run != " ")) & F.exists(r, lambda x: x.kind == "D")


def date_like(text: Column) -> Column:
    return text.rlike(r"(^|[^0-9])([0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4})($|[^0-9])")


def ratio(text: Column) -> Column:
    """N of a ratio 1:N that no digit or dot touches; null without one."""
    found = F.regexp_extract(text, r"(?:^|[^0-9.])1\s*:\s*([0-9]+)(?:$|[^0-9.])", 1)
    return found.try_cast("double")


def elevation(text: Column) -> Column:
    """Metres of a text such as +2.800, with up to four letters before its sign; null for others."""
    sign = F.regexp_extract(text, r"^\s*\p{L}{0,4}\s*([+-])[0-9]{1,3}[.,][0-9]{1,3}\s*$", 1)
    value = F.regexp_extract(text, r"^\s*\p{L}{0,4}\s*[+-]([0-9]{1,3}[.,][0-9]{1,3})\s*$", 1)
    metres = F.replace(value, F.lit(","), F.lit(".")).try_cast("double")
    return F.when(sign == "-", -metres).otherwise(metres)


def size(token: Column) -> Column:
    """A token of digits alone that is a possible nominal size."""
    number = F.when(token.rlike("^[0-9]+$"), token.try_cast("double"))
    return F.when(number.between(LEAST_SIZE, MOST_SIZE), number)


def trailing_size(text: Column) -> Column:
    """The part after the last dash, if it is a possible size."""
    return size(F.element_at(F.split(text, "-"), -1))


def trailing_digits(text: Column) -> Column:
    """Two to four digits at the end, after a dash or slash."""
    return F.regexp_extract(text, "[-/]([0-9]{2,4})$", 1).try_cast("double")


def system(text: Column) -> Column:
    """The first run of letters."""
    return F.nullif(F.regexp_extract(text, r"(\p{L}+)", 1), F.lit(""))


def dimension(word: Column) -> Column:
    """A size that a word states, with the rule that found it: DN, a diameter sign, AxB or a pair after DN; else null."""
    rules = (("pair", r"^(?i:DN)\s*([0-9]+)/[0-9]+$"), ("dn", r"^(?i:DN)\s*([0-9]+)$"), ("diameter", r"^(?:Ø|⌀|O/)\s*([0-9]+)$"), ("box", r"^([0-9]+)[xX×][0-9]+$"))
    out = F.lit(None).cast("struct<rule: string, mm: double>")
    for rule, regex in reversed(rules):
        mm = F.regexp_extract(word, regex, 1).try_cast("double")
        out = F.when(mm.isNotNull(), F.struct(F.lit(rule).alias("rule"), mm.alias("mm"))).otherwise(out)
    return out


def fuller(a: Column, b: Column) -> Column:
    """Of two readings, the one that adds a dash or slash and a number to the other; null if neither does."""
    more = lambda x, y: y.startswith(x) & F.substr(y, F.length(x) + 1).rlike("^[-/][0-9]+$")
    return F.when(more(a, b), b).when(more(b, a), a)


def number(text: Column) -> Column:
    """A number with a decimal point or comma; null for others."""
    return F.replace(F.trim(text), F.lit(","), F.lit(".")).try_cast("double")


def slug(stem: Column) -> Column:
    return F.regexp_replace(F.lower(stem), "[^a-z0-9]+", "-")
