"""Text formats of hits, all as Column expressions: one string a hit, with line breaks where a format has several lines.

Hits carry seq_id, header and norm_score beside the columns of the search.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import identifier, short_identifier, wrap
from ..operators.search import level_tags
from ..sources.profiles import Profile

WIDTH = 80
RED, PLAIN = "\x1b[31m", "\x1b[0m"


def _c(name: str) -> Column:
    return F.col(name)


def _sign(minus: str, plus: str) -> Column:
    return F.when(_c("orientation") == -1, minus).otherwise(plus)


# The format strings of this module; a format's readers rely on them.


def default(p: Profile, cycles: bool = False) -> Column:
    more = ("%7d ", [_c("cycles")]) if cycles else ("", [])
    return F.format_string("%7.3f %7d " + more[0] + "pos. %7d - %7d %s %s %s", _c("norm_score"), _c("score"), *more[1], _c("row_begin"), _c("row_end"), _sign("<", ">"), _c("header"), _c("aligned"))


def tsv(p: Profile, cycles: bool = False) -> Column:
    more = [_c("cycles").cast("string")] if cycles else []
    norm = F.format_string("%f", _c("norm_score"))
    return F.concat_ws("\t", F.lit(p.ac.split(";")[0]), identifier(_c("header")), _c("row_begin"), _c("row_end"), _c("score"), *more, norm, _c("aligned"))


def one_line(p: Profile) -> Column:
    norm = F.format_string("%f", _c("norm_score").cast("double"))
    return F.concat_ws("\t", F.lit(p.identification), identifier(_c("header")), _sign("-", "+"), _c("score"), norm, _c("col_begin"), _c("col_end"), F.lit(p.length), _c("seq_begin"), _c("seq_end"), _c("seq_len"))


def _motif(p: Profile) -> str:
    return f"{p.ac.split(';')[0]}|{p.identification.split(';')[0]}".replace("%", "%%")


def extended(p: Profile, width: int = WIDTH) -> Column:
    head = F.format_string("%s/%d-%d motif=" + _motif(p) + " norm_score=%.3f raw_score=%d level_tag=%d seq_end=%d motif_start=%d motif_end=%d", identifier(_c("header")), _c("row_begin"), _c("row_end"), _c("norm_score"), _c("score"), level_tags(p, _c("score")), _c("seq_end") - _c("seq_len"), _c("ipmb"), _c("ipme"))
    return F.concat(F.lit(">"), head, F.lit("\n"), wrap(_c("aligned"), width))


def fasta(p: Profile, width: int = WIDTH) -> Column:
    return F.concat(F.lit(">"), _c("header"), F.when(_c("orientation") == -1, " revcomp").otherwise(""), F.lit("\n"), wrap(_c("aligned"), width))


def simple(p: Profile) -> Column:
    return F.format_string("%s %d %f\n%s", identifier(_c("header")), _c("score"), _c("norm_score"), _c("aligned"))


def matched(p: Profile, width: int = WIDTH) -> Column:
    head = F.format_string(">%s/%d-%d motif=" + _motif(p) + " norm_score=%.3f raw_score=%d motif_start=%d motif_end=%d", identifier(_c("header")), _c("row_begin"), _c("row_end"), _c("norm_score"), _c("score"), _c("ipmb"), _c("ipme"))
    return F.concat(head, F.lit("\n"), wrap(_c("aligned"), width))


def maker(p: Profile, width: int = WIDTH) -> Column:
    head = F.format_string(">%s %8.3f %6d pos. %8d -%8d %s", short_identifier(_c("header")), _c("norm_score"), _c("score"), _c("row_begin"), _c("row_end"), _c("header"))
    return F.concat(head, F.lit("\n"), wrap(_c("aligned"), width))


def scan(p: Profile, width: int = WIDTH, strict: bool = False, numbered: bool = False) -> Column:
    """strict: a level's score must be exceeded; numbered: the identifier with the hit's rank."""
    name = F.concat_ws("_", identifier(_c("header")), _c("rank")) if numbered else identifier(_c("header"))
    head = F.format_string(">%s L=%d %8.3f %6d pos. %8d -%8d [%5d, %5d] " + _motif(p), name, level_tags(p, _c("score"), strict), _c("norm_score"), _c("score"), _c("row_begin"), _c("row_end"), _c("ipmb"), _c("ipme"))
    return F.concat(head, F.lit("\n"), wrap(_c("aligned"), width))


def scan_line(p: Profile) -> Column:
    return F.format_string("L=%d %8.3f %6d pos. %8d - %7d " + _motif(p) + " %s", level_tags(p, _c("score")), _c("norm_score"), _c("score"), _c("row_begin"), _c("row_end"), identifier(_c("header")))


def codons(p: Profile) -> Column:
    """A block with the aligned amino acids and, below each, a codon that stands for it."""
    from ..functions.sequence import amino_to_codons

    letters = F.upper(F.regexp_replace("aligned", "-", ""))
    head = F.format_string("ID %s\nIR %d\nIS %d\nSR %d\nSN %.3f\nCB %d\nCS %d", identifier(_c("header")), _c("rank"), _c("orientation"), _c("score"), _c("norm_score"), _c("col_begin"), _c("col_end"))
    return F.concat(head, F.lit("\nSA "), letters, F.lit("\nSD "), amino_to_codons(letters))


def codon_blocks(p: Profile, width: int = WIDTH) -> Column:
    """A record of a hit: numbered lines of tags, then blocks of four lines (consensus, states, amino acids, codons), three letters
    for each aligned one; a block ends with the letter that passes width - 4. Insertions are in small letters."""
    from ..functions.sequence import IUPAC_CODON

    code = F.create_map(*[F.lit(x) for pair in IUPAC_CODON.items() for x in pair])
    letters = F.filter(F.split("aligned", ""), lambda c: c != "")
    word = F.lit(p.consensus)
    framed = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    zero = F.struct((_c("ipmb") - 1).alias("at"), F.array().cast("array<struct<ex:string,as:string,sa:string,sd:string>>").alias("out"))

    def step(a: Column, c: Column) -> Column:
        codon = F.coalesce(F.try_element_at(code, F.upper(c)), F.lit("NNN"))
        inserted, gone = c.rlike("[a-z]"), c == "-"
        expected = F.when(inserted, "   ").otherwise(framed(F.substring(word, a["at"] + 1, F.lit(1))))
        state = F.when(inserted, "III").when(gone, "DDD").otherwise("MMM")
        letter = F.when(inserted, F.lower(codon)).when(gone, "---").otherwise(codon)
        item = F.struct(expected.alias("ex"), state.alias("as"), framed(c).alias("sa"), letter.alias("sd"))
        return F.struct((a["at"] + F.when(inserted, 0).otherwise(1)).alias("at"), F.concat(a["out"], F.array(item)).alias("out"))

    items = F.aggregate(letters, zero, step, lambda a: a["out"])
    each = max(1, (width - 4) // 3 + 1)  # letters of a block
    line = lambda own, name: F.array_join(F.transform(own, lambda x: x[name]), "")
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(letters), F.lit(1)), F.lit(each)), lambda i: i <= F.size(letters))
    blocks = F.transform(starts, lambda i: F.concat(*[x for n in ("ex", "as", "sa", "sd") for x in (F.lit(f"\n{n.upper()}\t"), line(F.slice(items, i, F.lit(each)), n))], F.lit("\n")))
    head = F.format_string("ID\t%d\nIR\t" + p.identification.replace("%", "%%") + "\nIS\t%s\nSR\t%d\nSN\t%f\nCB\t%d %d %d\nCS\t%d %d %d\n**", F.lit(1), identifier(_c("header")), _c("score"), _c("norm_score").cast("double"), _c("ipmb"), F.lit(p.length + 1) + _c("ipme"), F.lit(p.length), _c("row_begin"), _c("row_end"), _c("seq_len"))
    return F.concat(head, F.array_join(blocks, ""), F.lit("**\n//"))


def data_summary() -> Column:
    """Score, cycles, length and text of an alignment, with tabs."""
    return F.concat_ws("\t", "score", "cycles", F.length("aligned"), "aligned")


def highlighted(p: Profile, sequence: Column) -> Column:
    """The whole sequence with the hit in colour."""
    begin, end = _c("seq_begin"), _c("seq_end")
    return F.concat(F.lit(">"), _c("header"), F.lit("\n"), F.substring(sequence, F.lit(1), begin), F.lit(RED), F.substring(sequence, begin + 1, end - begin + 1), F.lit(PLAIN), F.substring(sequence, end + 2, F.length(sequence)))


#: What a terminal shows for a letter left out, and for the border of two cycles.
GONE, TURN = "\x1b[97-\x1b[31m", "\x1b[92m|\x1b[31m"


def highlighted_cycles(p: Profile, sequence: Column) -> Column:
    """The strand of a hit with the hit in colour, insertions in small letters, and marks for deletions and borders of cycles."""
    begin = _c("seq_begin")
    zero = F.struct((begin + 1).alias("at"), F.lit("").alias("text"))

    def step(a: Column, c: Column) -> Column:
        letter = F.substring(sequence, a["at"], F.lit(1))
        shown = F.when(c == "M", letter).when(c == "I", F.lower(letter)).when(c.isin("D", "-"), GONE).when(c == "R", TURN).otherwise("")
        return F.struct((a["at"] + F.when(c.isin("M", "I"), 1).otherwise(0)).alias("at"), F.concat(a["text"], shown).alias("text"))

    # after a wrap from an insertion the state is not named but its letter is used up
    body = F.aggregate(F.split("states", ""), zero, step, lambda a: a["text"])
    turns = F.length("states") - F.length(F.replace(_c("states"), F.lit("R"), F.lit("")))
    head = F.format_string(">%s direction=%s, raw_score=%d motif_start=%d motif_end=%d cycle=%d\n", _c("header"), _sign("<", ">"), _c("score"), _c("ipmb"), _c("ipme"), turns)
    return F.concat(head, F.substring(sequence, F.lit(1), begin), F.lit(RED + "\x1b[4m"), body, F.lit(PLAIN), F.substring(sequence, _c("seq_end") + 2, F.length(sequence)))


def mapping(sequence: Column) -> Column:
    return F.format_string("Sequence %s : %s %d-%d %d", sequence, _c("tag"), _c("begin"), _c("end"), _c("score"))


FORMATS = {"default": default, "tsv": tsv, "one_line": one_line, "extended": extended, "fasta": fasta, "simple": simple, "matched": matched, "maker": maker, "scan": scan, "scan_line": scan_line, "scan_strict": lambda p: scan(p, strict=True), "scan_numbered": lambda p: scan(p, numbered=True), "codons": codons, "codon_blocks": codon_blocks}


def lines(hits: DataFrame, profile: Profile, name: str, **options) -> DataFrame:
    """text: the hits in a format of FORMATS."""
    return hits.select(FORMATS[name](profile, **options).alias("text"))


def tab(cells: DataFrame) -> DataFrame:
    """text: matrix cells as lines of seq, prf, match, insertion, deletion."""
    return cells.select(F.concat_ws("\t", "seq", "prf", "match", "insertion", "deletion").alias("text"))


def rows_of(cells: DataFrame, state: str, key: str = "seq_id", by: str = "seq") -> DataFrame:
    """key, by, values: one state's scores of each matrix row (or, by prf, column); forbidden ones are -32767."""
    other = "prf" if by == "seq" else "seq"
    value = F.when(F.col(state) <= -16383, -32767).otherwise(F.col(state))
    listed = F.sort_array(F.collect_list(F.struct(F.col(other).alias("o"), value.alias("v"))))
    return cells.groupBy(key, by).agg(F.transform(listed, lambda r: r["v"]).alias("values"))


def write_counts(counts: DataFrame, path: str) -> None:
    """A histogram or density as one text file, its bins in order: numbers with tabs. Bins are as many as their range says."""
    *bins, n = counts.columns
    ordered = counts.coalesce(1).sortWithinPartitions(*bins)
    ordered.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in [*bins, n]]).alias("value")).write.text(path)


def accuracy(hits: DataFrame) -> DataFrame:
    """ok, failed: how many aligned texts equal their headers."""
    same = F.col("aligned") == F.col("header")
    return hits.agg(F.count_if(same).alias("ok"), F.count_if(~same).alias("failed"))
