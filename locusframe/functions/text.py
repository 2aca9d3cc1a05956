"""Cleaning of identifiers, tokens and genotype fields as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of accession names that stand for another one.
ID_ALIASES = {"BTX6": "BTX623", "BTX623": "BTX623", "SC748": "SC748_5", "SC7485": "SC748_5", "SC748_5": "SC748_5"}
#: Tokens of field books that mean a missing value.
MISSING_TOKENS = ("", ".", "MISSING", "missing", "Missing", "missintg", "MISSINTG", "NA", "N/A")
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def normalize_id(name: Column) -> Column:
    """Upper case without white space, ``_`` for ``-``, aliases replaced."""
    key = F.upper(F.replace(F.regexp_replace(name, r"\s+", ""), F.lit("-"), F.lit("_")))
    aliases = F.create_map(*(F.lit(x) for pair in ID_ALIASES.items() for x in pair))
    return F.coalesce(F.try_element_at(aliases, key), key)


def slugify(name: Column) -> Column:
    """Runs of other letters than ``A-Za-z0-9_.-`` as one ``_``, none at the ends."""
    return F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9_.\-]+", "_"), r"^_+|_+$", "")


def number_or_null(token: Column) -> Column:
    """A number, or null for missing tokens and anything else. The guard keeps out what casts read too generously."""
    t = F.trim(token)
    return F.when(t.isin(*MISSING_TOKENS), None).when(t.rlike(_NUMBER), t.try_cast("double"))


def stratum(location: Column, rep: Column, block: Column) -> Column:
    """``Location_R1``, ``Location_R1_B2``; NA for a missing replicate."""
    head = F.concat(location, F.lit("_R"), F.coalesce(rep.cast("bigint").cast("string"), F.lit("NA")))
    return F.when(block.isNull(), head).otherwise(F.concat(head, F.lit("_B"), block.cast("bigint").cast("string")))


def chromosome_number(name: Column, last: int = 10) -> Column:
    """1 to ``last``, read from names as ``Chr01`` or ``7``; null for others."""
    n = F.regexp_extract(F.trim(name), r"^(?i:chr)?0*(\d+)$", 1).try_cast("int")
    return F.when(n.between(1, last), n)


def genotype_code(call: Column) -> Column:
    """Number of alternative alleles of a diploid call; -1 for anything else."""
    alleles = F.split(call, r"[|/]")
    ok = (F.size(alleles) == 2) & F.forall(alleles, lambda a: a.isin("0", "1"))
    return F.when(ok, F.size(F.filter(alleles, lambda a: a == "1"))).otherwise(F.lit(-1)).cast("tinyint")


def genotype_field(formats: Column, sample: Column) -> Column:
    """The GT entry of a sample field, the first one where FORMAT names none, ``.`` where the field is too short."""
    at = F.array_position(F.split(formats, ":"), "GT")
    return F.coalesce(F.get(F.split(sample, ":"), F.greatest(at, F.lit(1)).cast("int") - 1), F.lit("."))


def marker_id(index: Column) -> Column:
    """``G`` and nine digits, counted from one."""
    return F.format_string("G%09d", index + 1)


def posix_path(path: Column) -> Column:
    """``C:\\a\\b`` as ``/mnt/c/a/b``."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    drive = F.regexp_extract(p, r"^([A-Za-z]):", 1)
    return F.when(drive != "", F.concat(F.lit("/mnt/"), F.lower(drive), F.regexp_replace(p, r"^[A-Za-z]:", ""))).otherwise(p)
