"""Text column expressions: accent stripping, tokenising, stop words,
sanitising and a light French stemmer.  All JVM-side (no Python UDF)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference for identical results.
# Token pattern of the count step: words of at least three ASCII letters,
# after lower-casing and accent stripping.
TOKEN_MIN_LETTERS = 3
# NLTK French stop-word list (public corpus), in its published order.
FRENCH_STOPWORDS = [
    "au", "aux", "avec", "ce", "ces", "dans", "de", "des", "du", "elle", "en",
    "et", "eux", "il", "ils", "je", "la", "le", "les", "leur", "lui", "ma",
    "mais", "me", "même", "mes", "moi", "mon", "ne", "nos", "notre", "nous",
    "on", "ou", "par", "pas", "pour", "qu", "que", "qui", "sa", "se", "ses",
    "son", "sur", "ta", "te", "tes", "toi", "ton", "tu", "un", "une", "vos",
    "votre", "vous", "c", "d", "j", "l", "à", "m", "n", "s", "t", "y", "été",
    "étée", "étées", "étés", "étant", "étante", "étants", "étantes", "suis",
    "es", "est", "sommes", "êtes", "sont", "serai", "seras", "sera", "serons",
    "serez", "seront", "serais", "serait", "serions", "seriez", "seraient",
    "étais", "était", "étions", "étiez", "étaient", "fus", "fut", "fûmes",
    "fûtes", "furent", "sois", "soit", "soyons", "soyez", "soient", "fusse",
    "fusses", "fût", "fussions", "fussiez", "fussent", "ayant", "ayante",
    "ayantes", "ayants", "eu", "eue", "eues", "eus", "ai", "as", "avons",
    "avez", "ont", "aurai", "auras", "aura", "aurons", "aurez", "auront",
    "aurais", "aurait", "aurions", "auriez", "auraient", "avais", "avait",
    "avions", "aviez", "avaient", "eut", "eûmes", "eûtes", "eurent", "aie",
    "aies", "ait", "ayons", "ayez", "aient", "eusse", "eusses", "eût",
    "eussions", "eussiez", "eussent",
]
# Words added by the pipeline to the French list.
EXTRA_STOPWORDS = ["unnamed", "http", "les", "des"]
# GeoJSON vocabulary removed as stop words.
GEOJSON_STOPWORDS = [
    "featurecollection", "geometry", "type", "polygon", "coordinates",
    "properties", "feature", "crs", "urn", "ogc", "def", "libelle",
    "multipolygon", "name", "point", "linestring", "multilinestring", "pprt",
    "ppri", "mvt", "nda", "bdx", "gid", "pci", "pprn",
]
# Tags ignored when labels are compared (split_labels, object clouds).
STOP_TAGS = ["passerelle_inspire", "donnees_ouvertes", "geoscientific_information",
             "grand_public"]
# End of fixed values.
# ---------------------------------------------------------------------------


def _accent_table() -> tuple[str, str]:
    """Single-character accent folding, derived from Unicode NFKD for the
    Latin blocks (rule-built, not a hand list)."""
    src, dst = [], []
    ranges = [(0x00C0, 0x0250), (0x1E00, 0x1F00)]
    for lo, hi in ranges:
        for cp in range(lo, hi):
            ch = chr(cp)
            decomposed = unicodedata.normalize("NFKD", ch)
            base = "".join(c for c in decomposed if not unicodedata.combining(c))
            if len(base) == 1 and base != ch:
                src.append(ch)
                dst.append(base)
    return "".join(src), "".join(dst)


ACCENT_FROM, ACCENT_TO = _accent_table()


def strip_accents_py(s: str) -> str:
    """Python twin of :func:`strip_accents` for small driver-side lists."""
    decomposed = unicodedata.normalize("NFKD", s)
    return "".join(c for c in decomposed if not unicodedata.combining(c))


def strip_accents(col: Column) -> Column:
    """Fold precomposed Latin accents and drop stray combining marks."""
    return F.regexp_replace(F.translate(col, ACCENT_FROM, ACCENT_TO), r"\p{M}", "")


def normalize_for_tokens(col: Column) -> Column:
    """lower-case, then strip accents (the count step's preprocessing order)."""
    return strip_accents(F.lower(col))


def stopwords(strip: bool = True) -> list[str]:
    """The full stop list.  ``strip=True`` folds accents of the list as the
    tokens are folded; ``strip=False`` keeps the original (accented) words,
    which then never match a token."""
    words = FRENCH_STOPWORDS + EXTRA_STOPWORDS + GEOJSON_STOPWORDS
    if strip:
        words = [strip_accents_py(w) for w in words]
    seen, out = set(), []
    for w in words:
        if w not in seen:
            seen.add(w)
            out.append(w)
    return out


def token_array(col: Column, stop: list[str] | None = None) -> Column:
    """Array of tokens of ``col`` (repeats kept), stop words removed.

    ``(?U)`` makes ``\\b`` Unicode-aware so that a word such as ``straße``
    yields no token, as in Python's ``re``.
    """
    pattern = r"(?U)\b[a-z]{%d,}\b" % TOKEN_MIN_LETTERS
    toks = F.regexp_extract_all(normalize_for_tokens(F.coalesce(col, F.lit(""))),
                                F.lit(pattern), 0)
    if stop:
        # IN over many literals is planned as a hash-set lookup
        toks = F.filter(toks, lambda t: ~t.isin(*stop))
    return toks


def sanitize_text(col: Column) -> Column:
    """``;`` → ``,``, ``"`` → ``'``, line breaks removed (catalogue output)."""
    return F.translate(col, ';"\n\r', ",'")


def clean_cell(col: Column) -> Column:
    """Spreadsheet cell cleaning: ``\\n``, ``\\r`` and ``;`` become spaces."""
    return F.translate(col, "\n\r;", "   ")


def _stem_sql(term: str) -> str:
    s1 = f"(CASE WHEN right({term}, 1) = 's' THEN substr({term}, 1, length({term}) - 1) ELSE {term} END)"
    s2 = f"(CASE WHEN right({s1}, 1) = 'r' THEN substr({s1}, 1, length({s1}) - 1) ELSE {s1} END)"
    s3 = f"(CASE WHEN right({s2}, 1) = 'e' THEN substr({s2}, 1, length({s2}) - 1) ELSE {s2} END)"
    s4 = (f"(CASE WHEN substr({s3}, length({s3}), 1) = substr({s3}, length({s3}) - 1, 1) "
          f"THEN substr({s3}, 1, length({s3}) - 1) ELSE {s3} END)")
    return (f"CASE WHEN length({term}) < 6 THEN {term} "
            f"WHEN right({term}, 3) = 'aux' THEN concat(substr({term}, 1, length({term}) - 2), 'l') "
            f"WHEN right({term}, 1) = 'x' THEN substr({term}, 1, length({term}) - 1) "
            f"ELSE {s4} END")


def light_french_stem_expr(column_name: str) -> Column:
    """Minimal French stemmer (Savoy 1999, as published) on a named column:
    words shorter than six letters unchanged; ``-aux`` -> ``-al``; other final
    ``x`` dropped; otherwise drop a final ``s``, then ``r``, then ``e``, then
    one letter of a final double letter.

    Written as a chain of anchored ``regexp_replace`` steps so that each step
    reads the previous one once (the expression stays linear in size)."""
    t = F.col(column_name)
    chain = F.regexp_replace(t, "s$", "")
    chain = F.regexp_replace(chain, "r$", "")
    chain = F.regexp_replace(chain, "e$", "")
    chain = F.regexp_replace(chain, r"([a-z])\1$", "$1")
    n = F.length(t)
    return (F.when(n < 6, t)
            .when(t.endswith("aux"), F.concat(F.expr(f"substr(`{column_name}`, 1, length(`{column_name}`) - 2)"),
                                               F.lit("l")))
            .when(t.endswith("x"), F.expr(f"substr(`{column_name}`, 1, length(`{column_name}`) - 1)"))
            .otherwise(chain))
