"""Column expressions over motif strings, site ids and residue letters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

AMINO = "ACDEFGHIKLMNPQRSTVWY"
# Residue groups, hydropathy scale.
POLAR, NONPOLAR, ACIDIC, BASIC, AROMATIC = "STYCNQ", "AVLIMFWPG", "DE", "KRH", "FWY"
HYDROPATHY = {"A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "Q": -3.5, "E": -3.5, "G": -0.4, "H": -3.2, "I": 4.5, "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2}
BACKGROUND = {"A": 0.0825, "R": 0.0553, "N": 0.0406, "D": 0.0546, "C": 0.0138, "Q": 0.0393, "E": 0.0672, "G": 0.0707, "H": 0.0227, "I": 0.0591, "L": 0.0965, "K": 0.058, "M": 0.0241, "F": 0.0386, "P": 0.0474, "S": 0.0665, "T": 0.0536, "W": 0.011, "Y": 0.0292, "V": 0.0686}
# BLOSUM62, the rows of its lower triangle over these letters.
BLOSUM_LETTERS = "ARNDCQEGHILKMFPSTWYVBZ"
BLOSUM62 = """
 4
-1  5
-2  0  6
-2 -2  1  6
 0 -3 -3 -3  9
-1  1  0  0 -3  5
-1  0  0  2 -4  2  5
 0 -2  0 -1 -3 -2 -2  6
-2  0  1 -1 -3  0  0 -2  8
-1 -3 -3 -3 -1 -3 -3 -4 -3  4
-1 -2 -3 -4 -1 -2 -3 -4 -3  2  4
-1  2  0 -1 -3  1  1 -2 -1 -3 -2  5
-1 -1 -2 -3 -1  0 -2 -3 -2  1  2 -1  5
-2 -3 -3 -3 -2 -3 -3 -3 -1  0  0 -3  0  6
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4  7
 1 -1  1  0 -1  0  0  0 -1 -2 -2  0 -1 -2 -1  4
 0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1  1  5
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1  1 -4 -3 -2 11
-2 -2 -2 -3 -2 -1 -2 -3  2 -1 -1 -2 -1  3 -3 -2 -2  2  7
 0 -3 -3 -3 -1 -2 -2 -3 -3  3  1 -2  1 -1 -2 -2  0 -3 -1  4
-2 -1  3  4 -3  0  1 -1  0 -3 -4  0 -3 -3 -2  0 -1 -4 -3 -3  4
-1  0  0  1 -3  3  4 -2  0 -3 -3  1 -1 -3 -1  0 -1 -3 -2 -2  1  4
"""
# Consensus motifs of kinases.
CONSENSUS = {
    "PKA_consensus": "R[RK].S",
    "PKC_consensus": "[ST].[RK]",
    "CK2_consensus": "S..E",
    "CK1_consensus": "S..[ST]",
    "proline_directed": "[ST]P",
    "GSK3_consensus": "S...S",
    "acidic_directed": "S.[DE]",
    "basic_directed": "S.[RK]",
    "CDK_consensus": "[ST]P.[RK]",
    "MAPK_consensus": "P.[ST]P",
    "ATM_ATR_consensus": "[ST]Q",
}
# Recognition patterns of a motif profile, with the kinases that they stand for.
RECOGNITION = {
    "CDK": ("[ST]P.?[KR]", ["CDK1", "CDK2", "CDK5"]),
    "MAPK/ERK": ("P.[ST]P", ["ERK1", "ERK2", "p38", "JNK"]),
    "PKA/PKG": ("[RK][RK].?[ST]", ["PKA", "PKG"]),
    "CK2": ("[ST]..[DE]", ["CK2"]),
    "GSK3": ("[ST]..[ST]", ["GSK3α", "GSK3β"]),
    "CK1": ("[DE]..[ST].[ST]", ["CK1"]),
    "PLK": ("[DE]..[ST]", ["PLK1"]),
    "Akt/PKB": ("R.R..[ST]", ["Akt1", "Akt2", "Akt3"]),
    "AGC": ("R.[ST]", ["PKA", "PKC", "PKG"]),
}


def standardize(motif: Column, w: int = 7) -> Column:
    """Cut to ``w`` letters on both sides of the middle (floor of half the length), padded with X."""
    middle = F.floor(F.length(motif) / 2).cast("int")
    before = F.substring(motif, F.lit(1), middle)
    after = F.substring(motif, middle + 2, F.length(motif))
    left = F.lpad(F.right(before, F.least(F.lit(w), F.length(before))), w, "X")
    right = F.rpad(F.left(after, F.lit(w)), w, "X")
    return F.when(motif.isNull() | (motif == ""), F.repeat(F.lit("X"), F.lit(2 * w + 1))).otherwise(F.concat(left, F.substring(motif, middle + 1, F.lit(1)), right))


def standardize_at(motif: Column, position: Column, w: int = 7) -> Column:
    """Pad on the left by the residue's place in its protein; nothing is padded on the right."""
    return F.concat(F.repeat(F.lit("X"), F.greatest(F.lit(0), F.lit(w) - (position - 1)).cast("int")), motif)


def central(motif: Column, w: int = 4) -> Column:
    """``w`` letters on both sides of the middle, unpadded; NULL under 2w+1 letters."""
    middle = F.floor(F.length(motif) / 2).cast("int")
    return F.when(F.length(motif) >= 2 * w + 1, F.substring(motif, middle + 1 - w, F.lit(2 * w + 1)))


def central_sql(motif: Column) -> Column:
    """The rounded-half form: for even lengths it begins one letter further left."""
    return F.when(F.length(motif) >= 9, F.substring(motif, F.round(F.length(motif) / 2 - 4).cast("int"), F.lit(9)))


def letters(motif: Column) -> Column:
    return F.split(motif, "")


def group_percent(motif: Column, group: str) -> Column:
    """Share of a residue group in a motif, centre included, in percent."""
    n = F.length(motif)
    return F.when(n > 0, F.regexp_count(motif, F.lit(f"[{group}]")) * 100.0 / n).otherwise(0.0)


def flank(motif: Column, w: int = 5) -> Column:
    """``w`` letters on each side of the middle, without it."""
    middle = F.floor(F.length(motif) / 2).cast("int")
    start = F.greatest(F.lit(1), middle + 1 - w)
    return F.concat(F.substring(motif, start, middle + 1 - start), F.substring(motif, middle + 2, F.lit(w)))


def flank_percent(motif: Column, group: str, w: int = 5) -> Column:
    side = flank(motif, w)
    return F.when(F.length(side) > 0, F.regexp_count(side, F.lit(f"[{group}]")) * 100.0 / F.length(side)).otherwise(0.0)


def _lookup(values: dict, key: Column, default: float | None = None) -> Column:
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    found = F.element_at(table, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def hydrophobicity(motif: Column, w: int = 5) -> Column:
    """Mean hydropathy of the flanks scaled to 0-100; 50 without known letters."""
    known = F.filter(F.transform(letters(flank(motif, w)), lambda a: _lookup(HYDROPATHY, a)), lambda x: x.isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)
    return F.when((F.length(motif) >= 3) & (F.size(known) > 0), (mean + 4.5) * 100 / 9).otherwise(50.0)


def residue_class(aa: Column) -> Column:
    classes = (("STY", "sty"), ("NQ", "nq"), ("C", "cys"), ("P", "proline"), ("AVILMFWG", "nonpolar"), ("DE", "acidic"), ("KRH", "basic"), ("X", "xxx"))
    return reduce(lambda c, x: c.when(F.lit(x[0]).contains(aa), x[1]), classes[1:], F.when(F.lit(classes[0][0]).contains(aa), classes[0][1])).otherwise("special")


def _blosum_cells() -> list[int]:
    """The whole matrix, row by row, over its letters and X, which scores -1 with all."""
    lower = [[int(v) for v in line.split()] for line in BLOSUM62.strip().splitlines()]
    n = len(lower)
    return [lower[max(i, j)][min(i, j)] if max(i, j) < n else -1 for i in range(n + 1) for j in range(n + 1)]


def pair_score(aa1: Column, aa2: Column) -> Column:
    """BLOSUM62 of two letters in capitals; a letter that it doesn't have counts as X, ``*`` scores -4 with all but itself."""
    n = len(BLOSUM_LETTERS) + 1
    place = lambda aa: F.when(F.instr(F.lit(BLOSUM_LETTERS), aa) > 0, F.instr(F.lit(BLOSUM_LETTERS), aa) - 1).otherwise(n - 1)
    cell = F.get(F.array(*map(F.lit, _blosum_cells())), place(aa1) * n + place(aa2))
    stars = (aa1 == "*").cast("int") + (aa2 == "*").cast("int")
    return F.when(stars == 2, 1).when(stars == 1, -4).otherwise(cell)


def substitution_similarity(a: Column, b: Column, variant: str = "mean", score=pair_score) -> Column:
    """Similarity of two motifs, in any case, by BLOSUM62 or another substitution score.

    ``mean``: mean over the length, 0 for unequal lengths. ``known``: mean over positions
    where neither letter is X. ``sum``: raw sum without X. ``score`` takes two letter
    columns, so that a matrix file can be used through :func:`matrix_score`.
    """
    pairs = F.filter(F.arrays_zip(letters(F.upper(a)).alias("x"), letters(F.upper(b)).alias("y")), lambda p: p["x"].isNotNull() & p["y"].isNotNull() & (p["x"] != "") & (p["y"] != ""))
    if variant != "mean":
        pairs = F.filter(pairs, lambda p: (p["x"] != "X") & (p["y"] != "X"))
    total = F.aggregate(pairs, F.lit(0).cast("int"), lambda s, p: s + score(p["x"], p["y"]).cast("int"))
    if variant == "sum":
        return total
    usable = (F.size(pairs) > 0) & (F.length(a) == F.length(b)) if variant == "mean" else F.size(pairs) > 0
    return F.when(usable, total / F.size(pairs)).otherwise(0.0)


def letter_codes(motif: Column) -> Column:
    """The places of a motif's letters in the whole matrix with X and ``*``, for :func:`coded_similarity`."""
    known = BLOSUM_LETTERS + "X*"
    return F.transform(letters(F.upper(motif)), lambda a: F.when(F.instr(F.lit(known), a) > 0, F.instr(F.lit(known), a) - 1).otherwise(len(BLOSUM_LETTERS)).cast("int"))


def coded_similarity(a: Column, b: Column, length: int) -> Column:
    """``substitution_similarity`` (mean) of two motifs of one known length by their letter codes: plain sums, many times quicker."""
    n = len(BLOSUM_LETTERS) + 1
    cells = _blosum_cells()
    whole = [cells[i * n + j] if max(i, j) < n else (1 if i == j else -4) for i in range(n + 1) for j in range(n + 1)]
    table = F.array(*map(F.lit, whole))
    return sum((F.get(table, F.get(a, F.lit(k)) * (n + 1) + F.get(b, F.lit(k))) for k in range(length)), F.lit(0)) / length


def matrix_score(matrix: dict[tuple[str, str], int], missing: int = -4):
    """A scoring rule from a symmetric substitution matrix, for example one read from a text file."""
    table = F.create_map(*[F.lit(x) for (p, q), v in matrix.items() for x in (p + q, v)])
    return lambda x, y: F.coalesce(F.element_at(table, F.concat(x, y)), F.element_at(table, F.concat(y, x)), F.lit(missing))


def read_matrix(text: str) -> dict[tuple[str, str], int]:
    """Parse the usual text layout: comment lines with #, a header of letters, a row for each letter."""
    rows = [line.split() for line in text.splitlines() if line.strip() and not line.startswith("#")]
    return {(r[0], c): int(v) for r in rows[1:] for c, v in zip(rows[0], r[1:], strict=True)}


def normalized_similarity(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (score + 20) / 40))


def uniprot_of(site_id: Column) -> Column:
    return F.regexp_extract(site_id, r"^(.*)_([STY]?)(\d+)$", 1)


def residue_type_of(site_id: Column, default: str | None = None) -> Column:
    """The letter of an id such as ``P1_S12``; the default (or NULL) without one."""
    found = F.nullif(F.regexp_extract(site_id, r"_([STY])\d+$", 1), F.lit(""))
    return found if default is None else F.coalesce(found, F.lit(default))


def residue_number_of(site_id: Column) -> Column:
    return F.nullif(F.regexp_extract(site_id, r"_[STY]?(\d+)$", 1), F.lit("")).cast("int")


def accessibility(neighbours: Column, most: int = 30) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), (most - neighbours) / most * 100.0))


def accessibility_from_sequence(window: Column) -> Column:
    """Estimate from the letters around a site where no structure is known."""
    n = F.greatest(F.length(window), F.lit(1))
    polar, hydrophobic = F.regexp_count(window, F.lit("[RKDENQSTYHC]")), F.regexp_count(window, F.lit("[AVILMFWPG]"))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 50.0 + 50.0 * (polar - hydrophobic) / n))


def known_kinases(*columns: Column) -> Column:
    """Kinases of several comma lists: unique, in order, without ``unlabeled`` and blanks, joined."""
    parts = F.flatten(F.transform(F.array_compact(F.array(*columns)), lambda c: F.split(c, r"\s*,\s*")))
    return F.concat_ws(", ", F.array_distinct(F.filter(F.transform(parts, F.trim), lambda x: (x != "") & (x != "unlabeled"))))


def first_kinase(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def is_known_kinase(label: Column) -> Column:
    """NULL counts as unknown, like ``unlabeled``."""
    return label.isNotNull() & (label != "unlabeled")


def motif_profile(motif: Column, site_type: Column) -> Column:
    """Group counts and shares of a motif without its centre, before and after it, the letters within three, and the patterns it shows.

    The centre is the eighth letter if that is the site's, else the middle (floor of half).
    """
    n, eighth = F.length(motif), F.substring(motif, 8, 1) == site_type
    middle = F.when(eighth, 7).otherwise(F.floor(n / 2)).cast("int")
    before, after = F.substring(motif, F.lit(1), middle), F.substring(motif, middle + 2, n)
    groups = {"polar": POLAR, "nonpolar": NONPOLAR, "acidic": ACIDIC, "basic": BASIC}
    known = "".join(groups.values())
    count = lambda text, name: F.regexp_count(text, F.lit(f"[{groups[name]}]" if name in groups else f"[^{known}]"))
    share = lambda k, of: F.when(of > 0, k * 100.0 / of).otherwise(0.0)
    cells = []
    for name in (*groups, "other"):
        up, down = count(before, name), count(after, name)
        cells += [(up + down).alias(f"{name}_count"), share(up + down, n - 1).alias(f"{name}_percent"), share(up, F.length(before)).alias(f"upstream_{name}"), share(down, F.length(after)).alias(f"downstream_{name}")]
    narrow = F.substring(motif, F.greatest(F.lit(1), middle - 2), middle + 4 - F.greatest(F.lit(0), middle - 3))
    shown = F.array(*[F.when(motif.rlike(p), F.struct(F.lit(k).alias("name"), F.array(*map(F.lit, who)).alias("kinases"), F.regexp_extract(motif, p, 0).alias("match"))) for k, (p, who) in RECOGNITION.items()])
    return F.struct(middle.alias("center"), *cells, narrow.alias("narrow"), F.array_compact(shown).alias("patterns"))


def covering_patterns(sequence: Column, position: Column, patterns: dict[str, str] = CONSENSUS, reach: int = 10) -> Column:
    """Names of the patterns of which a match covers the site, joined by commas; "None" without any.

    Each pattern is scanned from left to right through the ``reach`` letters around the site
    (numbered from 1), and a match hides those that overlap it: the walk over the texts
    between the matches carries the end of the last one. A pattern must not match nothing.
    """
    start = F.greatest(F.lit(1), position - reach)
    window, centre = F.substring(sequence, start, position - start + 1 + reach), position - start

    def covered(pattern: str) -> Column:
        steps = F.arrays_zip(F.split(window, pattern, -1).alias("gap"), F.regexp_extract_all(window, F.lit(f"({pattern})"), F.lit(1)).alias("hit"))

        def step(at: Column, x: Column) -> Column:
            begin = at["end"] + F.length(x["gap"])
            end = begin + F.coalesce(F.length(x["hit"]), F.lit(0))
            return F.struct(end.alias("end"), (at["covers"] | ((begin <= centre) & (centre < end))).alias("covers"))

        return F.aggregate(steps, F.struct(F.lit(0).alias("end"), F.lit(False).alias("covers")), step, lambda at: at["covers"])

    hits = [F.when(covered(p), F.lit(name)) for name, p in patterns.items()]
    return F.coalesce(F.nullif(F.concat_ws(", ", F.array_compact(F.array(*hits))), F.lit("")), F.lit("None"))


def dihedral(points: list[tuple[Column, Column, Column]]) -> Column:
    """Angle of four points in radians."""
    sub = lambda a, b: tuple(x - y for x, y in zip(a, b, strict=True))
    dot = lambda a, b: sum((x * y for x, y in zip(a, b, strict=True)), F.lit(0.0))
    cross = lambda a, b: (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
    b1, b2, b3 = (sub(points[k + 1], points[k]) for k in range(3))
    n1, n2 = cross(b1, b2), cross(b2, b3)
    return F.atan2(dot(cross(n1, n2), b2) / F.sqrt(dot(b2, b2)), dot(n1, n2))


def clean_number(x: Column, default: float | None = None) -> Column:
    """NaN and NULL to the default."""
    return F.coalesce(F.nanvl(x.cast("double"), F.lit(None).cast("double")), F.lit(default).cast("double"))


def normalized_text(x: Column) -> Column:
    """Ingest rule: empty text and ``unlabeled`` are missing; X stays."""
    return F.when((F.trim(x) == "") | (x == "unlabeled"), None).otherwise(x)
