"""The genetic code and motif tables, as literals and as small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The standard genetic code, codons in TCAG order.
BASES = "TCAG"
RESIDUES = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
STOPS = ("TAA", "TAG", "TGA")
#: Polyadenylation signals in two tiers.
POLYA = {"AATAAA": "strong", "ATTAAA": "strong", "AAGAAA": "weak", "AATACA": "weak", "AATAGA": "weak", "AATGAA": "weak"}
#: Recognition sites, both strands, of the Type IIS enzymes that assembly forbids.
TYPE_IIS = {"BsaI": ("GGTCTC", "GAGACC"), "BsmBI": ("CGTCTC", "GAGACG"), "SapI": ("GCTCTTC", "GAAGAGC")}


def code() -> dict[str, str]:
    return {a + b + c: RESIDUES[16 * i + 4 * j + k] for i, a in enumerate(BASES) for j, b in enumerate(BASES) for k, c in enumerate(BASES)}


def code_table(spark: SparkSession) -> DataFrame:
    """codon, aa: 64 rows."""
    return spark.createDataFrame(sorted(code().items()), "codon string, aa string")


def motif_table(spark: SparkSession, motifs: dict[str, str]) -> DataFrame:
    """motif, name: a table of a few rows."""
    return spark.createDataFrame(sorted(motifs.items()), "motif string, name string")


def codon_place(c: Column) -> Column:
    """A codon's place, from 1, in RESIDUES; null for anything else. One search in the list of all codons, where a map would be searched entry by entry."""
    listed = " ".join(code()) + " "
    return F.when(F.length(c) == 3, ((F.nullif(F.instr(F.lit(listed), F.concat(c, F.lit(" "))), F.lit(0)) + 3) / 4).cast("int"))


#: Recognition sites by assembly standard.
ASSEMBLY = {
    "golden_gate": {"BsaI": ("GGTCTC", "GAGACC"), "BpiI": ("GAAGAC", "GTCTTC"), "BsmBI": ("CGTCTC", "GAGACG")},
    "moclo": {"BsaI": ("GGTCTC", "GAGACC")},
    "biobricks": {"EcoRI": ("GAATTC",), "XbaI": ("TCTAGA",), "SpeI": ("ACTAGT",), "PstI": ("CTGCAG",)},
}
#: Kyte-Doolittle hydropathy in tenths.
HYDROPATHY = {
    "A": 18, "R": -45, "N": -35, "D": -35, "C": 25, "Q": -35, "E": -35, "G": -4, "H": -32, "I": 45,
    "L": 38, "K": -39, "M": 19, "F": 28, "P": -16, "S": -8, "T": -7, "W": -9, "Y": -13, "V": 42,
}
