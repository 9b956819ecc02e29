import gzip
import struct

from haplospark.sources import formats

HEADER = """##fileformat=VCFv4.2
##FILTER=<ID=PASS,Description="x",IDX=0>
##FILTER=<ID=low,Description="x",IDX=1>
##contig=<ID=c,length=400,IDX=0>
##contig=<ID=d,length=300,IDX=1>
##FORMAT=<ID=GT,Number=1,Type=String,Description="x",IDX=2>
##FORMAT=<ID=GQ,Number=1,Type=Integer,Description="x",IDX=3>
##FORMAT=<ID=PS,Number=1,Type=Integer,Description="x",IDX=4>
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS
"""


def text(s):
    n = len(s)
    return (bytes([n << 4 | 7]) if n < 15 else bytes([15 << 4 | 7, 0x11, n])) + s.encode()


def record(contig, pos, ref, alts, qual, filters, gt, gq, ps):
    shared = struct.pack("<iii", contig, pos, len(ref)) + (struct.pack("<I", 0x7F800001) if qual is None else struct.pack("<f", qual))
    shared += struct.pack("<II", (1 + len(alts)) << 16, 3 << 24 | 1) + text("") + b"".join(map(text, [ref, *alts])) + bytes([len(filters) << 4 | 1, *filters])
    own = bytes([0x11, 2, len(gt) << 4 | 1, *gt]) + bytes([0x11, 3, 0x11]) + struct.pack("<b", gq) + bytes([0x11, 4, 0x13]) + struct.pack("<i", ps)
    return struct.pack("<II", len(shared), len(own)) + shared + own


RECORDS = [
    (0, 9, "A", ["G"], 50.0, [0], [2, 5], 30, 70_000),  # 0|1
    (0, 19, "ACGTACGTACGTACGTACGT", ["A", "AT"], None, [1], [4, 6], -128, -(2**31)),  # 1/2
    (1, 0, "C", ["T"], 7.5, [], [0, 129], 9, 5),  # a missing allele; the second ends the vector
]


def test_bcf_equals_vcf(spark, tmp_path):
    head = HEADER.encode() + b"\0"
    raw = b"BCF\2\2" + struct.pack("<I", len(head)) + head
    body = [record(*r) for r in RECORDS]
    (tmp_path / "x.bcf").write_bytes(gzip.compress(raw) + gzip.compress(body[0]) + gzip.compress(body[1] + body[2]))
    (tmp_path / "x.vcf").write_text(
        HEADER + "c\t10\t.\tA\tG\t50\tPASS\t.\tGT:GQ:PS\t0|1:30:70000\nc\t20\t.\tACGTACGTACGTACGTACGT\tA,AT\t.\tlow\t.\tGT:GQ:PS\t1/2:.:.\nd\t1\t.\tC\tT\t7.5\t.\t.\tGT:GQ:PS\t.:9:5\n"
    )
    rows = [[tuple(r) for r in formats.read_vcf(spark, str(tmp_path / f"x.{k}"), "QUERY").drop("file_ord").collect()] for k in ("bcf", "vcf")]
    assert rows[0] == rows[1] and len(rows[0]) == 3
    assert formats.vcf_header(spark, str(tmp_path / "x.bcf")) == formats.vcf_header(spark, str(tmp_path / "x.vcf"))
