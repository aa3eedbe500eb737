"""Text, identifier and sequence expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values ---------------------------------------------------------------
# What Python's str.strip() removes; SQL trim() alone removes only spaces.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
LINE_BREAKS = "\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029"
MISSING_WORDS = ("nan", "none", "null")
FALSE_WORDS = ("false", "0", "no", "n", "")
DRUG_COLUMNS = (
    "drug_id", "drug_key", "Drug_ID", "drug", "compound_id",
    "SMILES_ChargeAware", "SMILES_Std", "SMILES", "smiles",
)
PROTEIN_COLUMNS = (
    "prot_id", "protein_key", "Protein_ID", "UniProt_ID",
    "uniprot_id", "protein_id", "target_id", "prot",
)
DRUG_NAME_COLUMNS = ("drug_key", "drug_id", "Drug_ID", "SMILES_ChargeAware", "SMILES_Std", "SMILES")
PROTEIN_NAME_COLUMNS = ("protein_key", "prot_id", "UniProt_ID", "Protein_ID", "uniprot_id", "protein_id")
DOMAIN_COLUMNS = ("prot_domain", "domain", "protein_domain", "protein_key")
# ----------------------------------------------------------------------------

# Every expression below mentions its input once. Filters repeat an input's
# expression at each mention, so nested double mentions would multiply.
_NUMBER = r"^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity))$"
_MISSING = f"^(?i:{'|'.join(MISSING_WORDS)})$"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def parse_number(c: Column) -> Column:
    """DOUBLE value of a decimal literal, NULL for anything else.

    The pattern keeps out literals only Java accepts, such as ``1d``.
    """
    return F.regexp_extract(strip(c.cast("string")), _NUMBER, 0).try_cast("double")


def number_of(df: DataFrame, name: str) -> Column:
    """A column's value as DOUBLE; numeric columns need no parsing."""
    if isinstance(df.schema[name].dataType, T.NumericType):
        return F.col(name).cast("double")
    return parse_number(F.col(name))


def clean_text(c: Column) -> Column:
    """Stripped text; NULL and the words for "missing" become empty."""
    return F.regexp_replace(strip(F.coalesce(c.cast("string"), F.lit(""))), _MISSING, "")


def without_digit_marks(c: Column) -> Column:
    """``1_000`` as ``1000``: underscores between digits are only marks."""
    return F.regexp_replace(c, "(?<=[0-9])_(?=[0-9])", "")


def to_float(c: Column) -> Column:
    return parse_number(without_digit_marks(clean_text(c)))


def false_ok(c: Column) -> Column:
    return F.lower(clean_text(c)).isin(*FALSE_WORDS)


def normalize_id(c: Column) -> Column:
    """Stripped id without one trailing ``.0``."""
    return F.regexp_replace(strip(c.cast("string")), r"\.0$", "")


def norm_keys(c: Column) -> Column:
    """Lookup keys of a value, most literal first: the stripped text and, when
    it reads as a whole number, that number's plain form."""
    text = strip(c.cast("string"))
    usable = ~F.lower(text).isin("", "nan")
    number = parse_number(without_digit_marks(text))
    # Exact to 2^106, in two parts of 53 bits; beyond that no plain form is offered.
    unit = F.lit(float(1 << 53))
    near = F.when(F.abs(number) < F.lit(float(1 << 106)), F.abs(number))
    high = F.floor(near / unit)
    low = (near - high.cast("double") * unit).cast("bigint")
    size = high.cast("decimal(19,0)") * F.lit(1 << 53).cast("decimal(16,0)") + low.cast("decimal(16,0)")
    whole = F.when(number < 0, -size).otherwise(size)
    integer = F.when(F.abs(number - whole.cast("double")) < F.lit(1e-8), whole.cast("string"))
    return (
        # Most ids are plain integers, which are their own only key.
        F.when(text.rlike("^(0|[1-9][0-9]{0,14})$"), F.array(text))
        .when(usable, F.array_distinct(F.array_compact(F.array(text, integer))))
        .otherwise(F.array().cast("array<string>"))
    )


def present(df: DataFrame, names: tuple[str, ...] | list[str]) -> list[str]:
    return [name for name in names if name in df.columns]


def as_text(df: DataFrame, name: str) -> Column:
    """Text of a column; NaN counts as missing."""
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(name), F.col(name)).cast("string")
    return F.col(name).cast("string")


def _first_present(df: DataFrame, names: tuple[str, ...], default: str) -> Column:
    return F.coalesce(*[as_text(df, n) for n in present(df, names)], F.lit(default))


def protein_name(df: DataFrame) -> Column:
    return _first_present(df, PROTEIN_NAME_COLUMNS, "unknown_protein")


def drug_name(df: DataFrame) -> Column:
    return _first_present(df, DRUG_NAME_COLUMNS, "unknown_drug")


def infer_domain(df: DataFrame) -> Column:
    """1 for a viral protein, 0 for a human or unstated one."""
    parts = [F.lower(as_text(df, n)) for n in present(df, DOMAIN_COLUMNS)]
    text = F.concat_ws(" ", *parts) if parts else F.lit("")
    return F.when(text.contains("virus") | text.contains("viral"), 1).otherwise(0)


def clean_sequence(c: Column) -> Column:
    """Residues of a FASTA or plain sequence: no header lines, no whitespace,
    upper case."""
    lines = F.split(F.translate(c, LINE_BREAKS, "\n" * len(LINE_BREAKS)), "\n")
    residues = F.filter(lines, lambda line: ~F.ltrim(line, F.lit(WHITESPACE)).startswith(">"))
    # Most sequences carry no header; those skip the line split.
    body = F.when(c.contains(">"), F.array_join(residues, "")).otherwise(c)
    return F.upper(F.translate(body, WHITESPACE, ""))


def safe_filename(c: Column) -> Column:
    return F.replace(c, F.lit("::"), F.lit("_"))
