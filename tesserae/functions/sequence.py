"""Sequence transforms as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: The standard genetic code, amino acids by codon in TCAG order.
GENETIC_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"

#: The IUPAC codon of each amino acid.
IUPAC_CODON = {
    "A": "GCN", "C": "TGY", "D": "GAY", "E": "GAR", "F": "TTY", "G": "GGN", "H": "CAY", "I": "ATH", "K": "AAR", "L": "YTN",
    "M": "ATG", "N": "AAY", "P": "CCN", "Q": "CAR", "R": "MGN", "S": "WSN", "T": "ACN", "V": "GTN", "W": "TGG", "Y": "TAY",
}


_SWAP = str.maketrans("ACGT", "TGCA")


def clean_keep_case(raw: Column) -> Column:
    """Letters only, as they are."""
    return F.regexp_replace(raw, "[^A-Za-z]", "")


def clean(raw: Column) -> Column:
    """Letters only, upper case."""
    return F.translate(clean_keep_case(raw), LOWER, UPPER)


def reverse_complement(seq: Column) -> Column:
    """Reversed, A-T and C-G swapped; any other letter stays."""
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def reverse_complement_strict(seq: Column) -> Column:
    """Reversed, A-T and C-G swapped; any other letter becomes a question mark."""
    return F.reverse(F.translate(F.regexp_replace(seq, "[^ACGT]", "?"), "ACGT", "TGCA"))


def complement_alphabet(seq: Column, iupac: bool = False) -> Column:
    """Letters replaced by their complements, in place; iupac: ambiguity codes too."""
    return F.translate(seq, "ATCGMKRYVBHD", "TAGCKMYRBVDH") if iupac else F.translate(seq, "ATCG", "TAGC")


def encode(seq: Column, alphabet: str) -> Column:
    """Alphabet positions from 1 of the letters of a cleaned sequence; undeclared letters are 0."""
    place = F.create_map(*[x for i, c in enumerate(alphabet, 1) for x in (F.lit(c), F.lit(i))])
    letters = F.filter(F.split(seq, ""), lambda c: c != "")
    return F.transform(letters, lambda c: F.coalesce(F.try_element_at(place, c), F.lit(0)))


def identifier(header: Column) -> Column:
    """The header up to its first space."""
    return F.split(header, " ")[0]


def short_identifier(header: Column) -> Column:
    """The part of the identifier after its last bar or greater-than sign."""
    return F.regexp_extract(identifier(header), r"([^|>]*)$", 1)


def wrap(text: Column, width: int = 80) -> Column:
    """Line breaks after every `width` characters, none at the end; empty stays empty. One pass, whatever the length."""
    return F.regexp_replace(text, f"(?s)(.{{{width}}})(?=.)", "$1\n")


def _amino(codons: Column, complement: bool) -> Column:
    """The amino acids of codons; one that ends in N is that of all its readings if they agree. Codons with other letters are X."""
    code = {a + b + c: GENETIC_CODE[16 * i + 4 * j + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}
    for start in {c[:2] for c in code}:
        readings = {code[start + c] for c in "TCAG"}
        if len(readings) == 1:
            code[start + "N"] = readings.pop()
    if complement:
        code = {codon.translate(_SWAP): amino for codon, amino in code.items()}
    table = F.create_map(*[F.lit(x) for pair in code.items() for x in pair])
    return F.array_join(F.transform(codons, lambda c: F.coalesce(F.try_element_at(table, c), F.lit("X"))), "")


def translate_frame(seq: Column, frame: int = 0, complement: bool = False, backwards: bool = False) -> Column:
    """Amino acids of the codons of a frame 0, 1 or 2; stops are *, codons with other letters X, a rest is dropped.

    complement: letters stand for their partners; backwards: the sequence is read from its end. Both: the other strand.
    """
    own = F.reverse(seq) if backwards else seq
    return _amino(F.regexp_extract_all(F.substring(own, frame + 1, 2147483647), F.lit("(?s)..."), F.lit(0)), complement)


def interleaved_translation(seq: Column) -> Column:
    """One amino acid for each position that starts a codon, all three frames in turn."""
    return _amino(F.regexp_extract_all(seq, F.lit("(?s)(?=(...))"), F.lit(1)), False)


def amino_to_codons(seq: Column) -> Column:
    """Each amino acid's IUPAC codon; NNN for other letters."""
    code = F.create_map(*[F.lit(x) for pair in IUPAC_CODON.items() for x in pair])
    letters = F.filter(F.split(seq, ""), lambda c: c != "")
    return F.array_join(F.transform(letters, lambda c: F.coalesce(F.try_element_at(code, c), F.lit("NNN"))), "")


def run_lengths(states: Column) -> Column:
    """Runs of equal letters as letter and length, such as M12I2."""
    runs = F.regexp_extract_all(states, F.lit(r"((.)\2*)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.substring(r, 1, 1), F.length(r).cast("string"))), "")


#: The code of each operation and how many fit.
CIGAR_CODES = {"M": 0xA, "I": 0xB, "D": 0xC}
CIGAR_SIZE = 124


def packed_cigar(states: Column) -> Column:
    """The operations of an alignment as whole numbers: code A, B or C (match, insertion, deletion) in bits 12 on, length below.

    Entry and exit are left out; runs longer than 4095 are several operations. Null where more than 124 do not fit, or
    for states that have no code (wraps).
    """
    runs = F.regexp_extract_all(F.translate(F.replace(states, F.lit("X"), F.lit("")), "-", "D"), F.lit(r"((.)\2{0,4094})"), F.lit(1))
    code = F.create_map(*[F.lit(x) for pair in CIGAR_CODES.items() for x in pair])
    packed = F.transform(runs, lambda r: F.try_element_at(code, F.substring(r, 1, 1)) * 4096 + F.length(r))
    return F.when((F.size(runs) <= CIGAR_SIZE) & ~F.exists(packed, lambda c: c.isNull()), packed)


def cigar_text(packed: Column) -> Column:
    """Packed operations as text, such as 12M2I."""
    letter = F.create_map(*[F.lit(x) for c, v in CIGAR_CODES.items() for x in (v, c)])
    return F.array_join(F.transform(packed, lambda c: F.concat((c % 4096).cast("string"), F.try_element_at(letter, F.shiftright(c, 12)))), "")
