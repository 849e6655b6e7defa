"""Column functions on sequences, k-mers and scores.

Base codes are ordered A < C < G < T and a packed k-mer has its oldest base highest, so the order of equally long ACGT
texts is that of their packed numbers (up to 31 bases, so that the number fits a long without its sign).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"


def revcomp(seq: Column) -> Column:
    """Reverse complement; letters other than A, C, G, T stay, letter case is kept."""
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def canonical(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement."""
    return F.least(kmer, revcomp(kmer))


def kmer_text(packed: Column, k: int) -> Column:
    """Letters of a packed k-mer."""
    return F.translate(F.lpad(F.conv(packed.cast("string"), 10, 4), k, "0"), "0123", BASES)


def kmer_packed(text: Column) -> Column:
    """Number of a k-mer of up to 31 letters A, C, G, T."""
    return F.conv(F.translate(F.upper(text), BASES, "0123"), 4, 10).cast("long")


def base_code(base: Column) -> Column:
    """0 to 3 for A, C, G, T in either case, else null."""
    at = F.instr(F.lit(BASES), F.upper(base))
    return F.when((F.length(base) == 1) & (at > 0), at - 1)


def base_letter(code: Column) -> Column:
    return F.when(code.between(0, 3), F.substring(F.lit(BASES), code + 1, F.lit(1)))


@dataclass(frozen=True)
class SpacedSeed:
    """A pattern of 1 (compared) and 0 (ignored) places.

    At most 32 long, beginning and ending with 1, and symmetric unless any_shape is set, so that both strands give the
    same seed.
    """

    pattern: str
    any_shape: bool = False

    def __post_init__(self) -> None:
        p = self.pattern
        if not p or set(p) - {"0", "1"} or len(p) > 32 or p[0] != "1" or p[-1] != "1":
            raise ValueError(f"not a seed pattern: {p!r}")
        if not self.any_shape and p != p[::-1]:
            raise ValueError(f"not a symmetric seed pattern: {p!r}")

    @classmethod
    def contiguous(cls, k: int) -> SpacedSeed:
        return cls("1" * k)

    @property
    def span(self) -> int:
        return len(self.pattern)

    @property
    def weight(self) -> int:
        return self.pattern.count("1")

    def runs(self) -> list[tuple[int, int]]:
        """Offset and length of each run of compared places."""
        return [(m.start(), m.end() - m.start()) for m in re.finditer("1+", self.pattern)]

    def extract(self, window: Column) -> Column:
        """The compared letters of a window of the span's length."""
        return F.concat(*[F.substring(window, at + 1, n) for at, n in self.runs()])


def only_acgt(window: Column) -> Column:
    return ~window.rlike("[^ACGT]")


def gc_fraction(seq: Column) -> Column:
    """Share of G and C in either case, null for an empty sequence."""
    return F.when(F.length(seq) > 0, F.length(F.regexp_replace(seq, "[^GCgc]", "")) / F.length(seq))


def complex_enough(packed: Column, weight: int) -> Column:
    """Of a packed seed: at least three different bases, none on more than weight - 3 places.

    A base is counted by comparing all places with it at once: a place agrees if both its bits do.
    """
    every = sum(1 << (2 * i) for i in range(weight))
    n = []
    for code in range(4):
        differ = packed.bitwiseXOR(F.lit(every * code).cast("long"))
        n.append(weight - F.bit_count(differ.bitwiseOR(F.shiftright(differ, 1)).bitwiseAND(F.lit(every).cast("long"))))
    return (sum(F.when(x > 0, 1).otherwise(0) for x in n) >= 3) & (F.greatest(*n) <= weight - 3)


def trim_runs(seq: Column, least: int = 8) -> Column:
    """Without a run of at least `least` equal bases at the start, and then at the end."""
    run = "|".join(f"{b}{{{least},}}" for b in BASES)
    return F.regexp_replace(F.regexp_replace(seq, f"^({run})", ""), f"({run})$", "")


def log2_bucket(count: Column) -> Column:
    """Whole part of the binary logarithm; counts below 1 are in bucket 0."""
    return F.length(F.bin(F.greatest(count, F.lit(1)).cast("long"))) - 1


def ratio(over: Column, under: Column) -> Column:
    """over / under, 0 where under is 0."""
    return F.when(under > 0, over / under).otherwise(F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))


def sequence_id(header: Column) -> Column:
    """First word of a header, without a leading '>'; the whole header if it has none."""
    return F.element_at(F.split(F.trim(F.regexp_replace(header, "^>", "")), r"\s+"), 1)


def wrap80(seq: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(seq, "(.{80})", "$1\n"), "\n$", "")


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))


# Groups of repeat families, and the families in each.
FAMILY_GROUPS = {
    "SINE/Alu": ["SINE/Alu"],
    "LINE/L1": ["LINE/L1"],
    "LTR/ERVK": ["LTR/ERVK"],
    "LTR/ERV1": ["LTR/ERV1"],
    "LTR/ERVL-MaLR": ["LTR/ERVL-MaLR"],
    "LTR/ERVL": ["LTR/ERVL"],
    "DNA/TcMar": ["DNA/TcMar-Tigger", "DNA/TcMar-Tc1", "DNA/TcMar-Tc2", "DNA/TcMar-Mariner", "DNA/TcMar-Pogo"],
    "DNA/hAT": ["DNA/hAT-Charlie", "DNA/hAT-Tip100", "DNA/hAT-Blackjack", "DNA/hAT-Ac", "DNA/hAT-Tag1"],
    "Satellite": ["Satellite", "Satellite/centr", "Satellite/acro", "Satellite/subtelo"],
    "Simple/Low": ["Simple_repeat", "Low_complexity"],
    "Ancient": ["SINE/MIR", "LINE/L2", "LINE/CR1", "RC/Helitron", "SINE/5S-Deu-L2", "SINE/tRNA", "SINE/tRNA-Deu", "SINE/tRNA-RTE"],
}
# Patterns in a consensus name and the family each stands for; the first that matches counts.
NAME_PATTERNS = [(r"\bAlu\b", "SINE/Alu"), (r"\bL1\b", "LINE/L1"), ("ERVK", "LTR/ERVK"), ("ERV1", "LTR/ERV1"), ("ERVL-MaLR", "LTR/ERVL-MaLR"), ("ERVL", "LTR/ERVL"), ("TcMar|Tigger|Tc1|Tc2|Mariner|Pogo", "DNA/TcMar"), ("Tip100|Charlie|Blackjack|hAT", "DNA/hAT"), ("Satellite", "Satellite"), ("Simple_repeat|Low_complexity", "Simple/Low"), ("MIR", "SINE/MIR"), ("L2", "LINE/L2"), ("CR1", "LINE/CR1"), ("Helitron", "RC/Helitron")]


def family_of_name(name: Column, unknown: str = "Unknown") -> Column:
    """Family that a consensus name stands for; '<family>_denovo' names it, with '_' for '/'."""
    base = F.substring_index(name, "#", 1)
    plain = F.substring_index(base, "_var", 1)
    out = F.when(base.endswith("_denovo"), F.translate(F.replace(base, F.lit("_denovo"), F.lit("")), "_", "/"))
    for pattern, family in NAME_PATTERNS:
        out = out.when(plain.rlike(pattern), F.lit(family))
    return out.otherwise(F.lit(unknown))


def family_group(family: Column) -> Column:
    """The group of a family, 'Other' for one in none."""
    out = F.when(F.lit(False), F.lit(""))
    for group, members in FAMILY_GROUPS.items():
        out = out.when(family.isin(members), F.lit(group))
    return out.otherwise(F.lit("Other"))
