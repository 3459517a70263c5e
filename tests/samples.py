"""Small alignments in SAM text, for tests. What they decode to was worked out by hand."""

HEADER = "@HD\tVN:1.6\tSO:unsorted\n@SQ\tSN:north\tLN:30\n@SQ\tSN:south\tLN:60\n@SQ\tSN:west\tLN:90\n"
#: Forty bases without tags.
FORTY = "GTTAGCACTTGACCGATATTCGGCATGAACTTGCAGGTCA"


def line(name, flag, contig, pos, mapq, cigar, seq, qual="*", mm=None, ml=None, tags=("MM", "ML")):
    more = ["NM:i:0"]
    if ml is not None:
        more.append(f"{tags[1]}:B:C{''.join(f',{x}' for x in ml)}")
    if mm is not None:
        more.append(f"{tags[0]}:Z:{mm}")
    return "\t".join(map(str, [name, flag, contig, pos, mapq, cigar, "*", 0, 0, seq, qual, *more])) + "\n"


# read-a: C at 0, 2, 3, 6, 8, of which the second, third and fifth are called.
# read-c: G at 2, 5, 9, 10, 15, 18, 21; read from its end, the second, third, fifth and seventh are called.
# read-b, unmapped: G at 0, 1, 5, 8, 9, of which every other one is called; C at 4, 7, 13.
FOUR = [
    line("read-a", 0, "north", 6, 40, "10M", "CACCGTCTCA", "*", "C+m?,1,0,1;", (12, 30, 55)),
    line("read-b", 0, "west", 31, 7, "40M", FORTY),
    line("read-c", 16, "south", 11, 255, "24M", "TTGACGATAGGTTACGTAGATGAA", "*", "C+m?,1,0,1,1;", (201, 7, 9, 140)),
    line("read-b", 4, "*", 0, 0, "*", "GGATCGTCGGATAC", "*", "G-4321?,0,1,1;C+m?,0,0,0;", (5, 60, 0, 220, 131, 20)),
]
# C at 0, 3, 4, 7; the second of them is inserted.
INDEL = [line("read1", 0, "north", 4, 60, "2M1D2I3=1X", "CATCCGAC", "5I+?;&<2", "C+m?,0,0,0,0;", (10, 90, 77, 21))]
# C at 1, 2, 5, 7, with qualities 0, 50, 53 and 42.
QUALITIES = [line("read1", 0, "north", 21, 60, "8M", "ACCTGCAC", "=!S0AV#K", "C+m?,0,1,0;", (8, 44, 90))]
# C at 1, 2, 5, 8, 9, the last one clipped; on the other strand these are G, in the opposite order.
IMPLICIT = [
    line("implicit", 0, "north", 3, 60, "9M1S", "TCCATCGACC", "5:?DI+&<2=", "C+m,1,0;", (66, 140)),
    line("explicit", 0, "north", 3, 60, "9M1S", "TCCATCGACC", "5:?DI+&<2=", "C+m?,1,0;", (66, 140)),
    line("reverse", 16, "north", 3, 60, "9M1S", "TCCATCGACC", "5:?DI+&<2=", "G+g,1,0;", (66, 140)),
]
ZERO = [line("read1", 0, "north", 4, 60, "8M", "*", "*", "C+m?,0,0;", (10, 90)), line("read2", 0, "west", 31, 60, "40M", FORTY)]
SHORT_QUALITY = [line("bad", 0, "north", 21, 60, "8M", "ACCTGCAC", "=!S0A", "C+m?,0;", (8,))]


def write(folder, records, name="reads.sam"):
    path = folder / name
    path.write_text(HEADER + "".join(records))
    return str(path)
