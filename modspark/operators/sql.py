"""Operators for users of SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from modspark.session import ship


class _Calls:
    def eval(self, flag: int, contig: str, pos: int, cigar: str, seq: str, qual: str, mm: str, ml: list):
        from modspark.operators.decode import decode_record
        from modspark.options import ModFilter

        if not seq:
            return
        for n, t in enumerate(decode_record(flag, contig, pos, cigar, seq, qual, mm, ml, ModFilter())):
            for at, ref, q in zip(t.pos.tolist(), t.ref.tolist(), t.qual.tolist()):
                yield n, t.base, t.strand, t.code, at, ref if ref >= 0 else None, q


def register(spark: SparkSession) -> None:
    """mm_ml_calls(flag, contig, pos, cigar, seq, qual, mm, ml): the calls of a record, for LATERAL joins."""
    ship(spark)
    made = udtf(_Calls, returnType="track_no int, base string, mod_strand string, mod_code string, call_pos int, ref_pos int, probability int")
    spark.udtf.register("mm_ml_calls", made)
