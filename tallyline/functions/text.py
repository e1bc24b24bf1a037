"""Text normalisation as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with marks and the plain letters they are read as.
MARKED = "àáâãäåāăąçćčďèéêëēėęěìíîïīįłñńňòóôõöøōőřśšşťùúûüūůűýÿźżž"
PLAIN_ = "aaaaaaaaacccdeeeeeeeeiiiiiilnnnoooooooorssstuuuuuuuyyzzz"


def norm(column) -> Column:
    """Lower case without accents, '.' and '-' as spaces, quotes dropped, only a-z 0-9 & / and single spaces."""
    c = F.translate(F.lower(column), MARKED, PLAIN_)
    c = F.regexp_replace(c, r"[.\-]", " ")
    c = F.regexp_replace(c, "[^a-z0-9&/ ]", "")
    return F.trim(F.regexp_replace(c, " +", " "))


def tokens(column) -> Column:
    return F.filter(F.split(norm(column), " "), lambda t: t != "")


def initials_fit(short: Column, full: Column) -> Column:
    """Whether each given-name token of `short` begins the one of `full` at its place."""
    pairs = F.zip_with(short, full, lambda a, b: a.isNull() | (b.isNotNull() & (b.startswith(a) | a.startswith(b))))
    return F.forall(pairs, lambda x: x) & (F.size(short) <= F.size(full))
