"""Sample identity and accession helpers (F9-F16, F39, P11) as Column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The run-accession pattern that makes a text a real accession list, and the
# run-name pattern of the workflow wrapper.
RUN_ACCESSION_RE = r"\b[SED]RR\d+\b"
RUN_NAME_RE = r"(?i)^r[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_srrs(c) -> Column:
    """split on ';', trim, drop blanks -> array<string> (NULL text -> empty array)."""
    parts = F.transform(F.split(F.coalesce(_col(c), F.lit("")), ";"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != F.lit(""))


def normalize_srrs(arr) -> Column:
    """sorted distinct tokens joined by ';'."""
    return F.array_join(F.array_sort(F.array_distinct(_col(arr))), ";")


def sample_id(c) -> Column:
    """content-derived sample id = md5 of the normalised accession list."""
    return F.md5(normalize_srrs(parse_srrs(c)))


def derive_sample_id(c) -> Column:
    """NULL unless the text holds a run accession; then the id of *all* its tokens."""
    return F.when(_col(c).rlike(RUN_ACCESSION_RE), sample_id(c))


def has_accession(c) -> Column:
    """at least one non-blank token."""
    return F.size(parse_srrs(c)) > 0


def classify_source(c) -> Column:
    """PRJ* -> bioproject, SRP/ERP/DRP -> sra_study, otherwise NULL (rejected)."""
    acc = F.upper(F.trim(_col(c)))
    return (F.when(acc.startswith("PRJ"), F.lit("bioproject"))
            .when(acc.substr(1, 3).isin("SRP", "ERP", "DRP"), F.lit("sra_study")))


def canon_label(c) -> Column:
    """stripped text, or 'unknown' when blank/NULL."""
    return F.coalesce(F.nullif(F.trim(_col(c)), F.lit("")), F.lit("unknown"))


def is_amplicon(strategy, selection) -> Column:
    """F16: AMPLICON strategy or PCR selection."""
    return (F.upper(F.trim(_col(strategy))) == "AMPLICON") | (F.upper(F.trim(_col(selection))) == "PCR")


def is_run_name(c) -> Column:
    """a wrapper run name, 'r' + uuid, case-insensitive."""
    return F.coalesce(_col(c).rlike(RUN_NAME_RE), F.lit(False))


def is_orphan(c) -> Column:
    """Accession NULL or blank once whitespace and ';' are removed."""
    return F.coalesce(F.length(F.regexp_replace(_col(c), r"[\s;]", "")) == 0, F.lit(True))
