"""Files written by all tasks at their places, block-compressed files read by ranges, and the candidates' re-scan."""

import gzip
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.operators import kinship, models, tables
from locusframe.operators.numbering import numbered
from locusframe.sources import blocks, placed, plink, text_formats


def blocked(data, size):
    """Members of ``size`` bytes of text, each telling its own size, and the empty last one."""
    out = b""
    for at in [*range(0, len(data), size), None]:
        part = b"" if at is None else data[at : at + size]
        deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = deflate.compress(part) + deflate.flush()
        out += b"\x1f\x8b\x08\x04" + bytes(6) + struct.pack("<HccHH", 6, b"B", b"C", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def vcf(records=400, samples=6, seed=2):
    rng = np.random.default_rng(seed)
    lines = ["##x", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + "\t".join(f"s{i}" for i in range(samples))]
    for i in range(records):
        chrom = ["Chr01", "2", "chr010", "scaffold"][i % 4 if i % 9 else 3]
        alt, pos = ("A,T" if i % 13 == 0 else "A"), ("x" if i % 17 == 0 else 10 * i)
        calls = [f"{a}/{b}:{rng.integers(9)}" if rng.random() > 0.1 else "./." for a, b in rng.integers(0, 2, (samples, 2))]
        lines.append("\t".join(map(str, [chrom, pos, "." if i % 3 else f"id{i}", "G", alt, ".", ".", "." * int(rng.integers(1, 300)), "GT:DP", *calls])) if i % 19 else "short\tline")
    return "\n".join(lines) + "\n"


@pytest.mark.parametrize(("size", "task"), [(37, 200), (1000, 300), (1000, 5000), (50_000, 1 << 24)])
@pytest.mark.parametrize("end", ["\n", ""])
def test_each_line_once_in_order(size, task, end, spark, tmp_path):
    text = vcf().rstrip("\n") + end
    path = tmp_path / "a.vcf.bgz"
    path.write_bytes(blocked(text.encode(), size))
    got = blocks.block_lines(spark, str(path), task_bytes=task).collect()
    assert [r["value"] for r in sorted(got, key=lambda r: r["line"])] == text.rstrip("\n").split("\n")
    assert len({r["line"] for r in got}) == len(got)


def test_blocks_read_like_the_plain_file(spark, tmp_path, monkeypatch):
    plain, packed = tmp_path / "a.vcf", tmp_path / "b.vcf.gz"
    plain.write_text(vcf())
    packed.write_bytes(blocked(vcf().encode(), 700))
    whole = tmp_path / "c.vcf.gz"
    whole.write_bytes(gzip.compress(vcf().encode()))
    assert blocks.is_blocked(str(packed)) and not blocks.is_blocked(str(whole)) and not blocks.is_blocked(str(plain))
    monkeypatch.setattr(blocks.block_lines, "__defaults__", (None, None, 900))
    assert blocks.block_lines(spark, str(packed)).rdd.getNumPartitions() > 5
    assert gzip.decompress(packed.read_bytes()).decode() == vcf()
    seen = []
    for path in (plain, packed, whole):
        assert text_formats.vcf_samples(spark, str(path)) == [f"s{i}" for i in range(6)]
        kept, reasons = text_formats.read_vcf(spark, str(path), [4, 0, 2], 0.05, 0.4)
        seen.append((sorted(tuple(map(str, r)) for r in kept.collect()), sorted(map(tuple, reasons.collect()))))
    assert seen[0] == seen[1] == seen[2] and len(seen[0][1]) > 5 and len(seen[0][0]) > 50
    near = [sorted(map(str, text_formats.vcf_records(spark, str(p), [1], (1, 400, 2000)).drop("line").collect())) for p in (plain, packed)]
    assert near[0] == near[1] and 5 < len(near[0]) < 60


def test_broken_blocks_stop(spark, tmp_path):
    path = tmp_path / "a.vcf.gz"
    path.write_bytes(blocked(vcf().encode(), 700)[:-40])
    with pytest.raises(Exception, match="no whole block"):
        blocks.block_lines(spark, str(path)).collect()


def panel(spark, rows=97, samples=11, seed=4):
    g = np.random.default_rng(seed).integers(-1, 3, (rows, samples))
    data = [(i, i % 10 + 1, 100 * i, [int(x) for x in r]) for i, r in enumerate(g)]
    return spark.createDataFrame(data, "variant_index long, CHR int, pos long, dosages array<tinyint>").repartition(6), g


def test_rows_at_their_places(spark, tmp_path):
    d = spark.range(0, 5000, numPartitions=7).select(F.concat(F.col("id").cast("string"), F.lit("\n")).alias("v"), (F.col("id") * 7919 % 5003).alias("k"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ordered = numbered(d, [F.col("k")], "n")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ordered.rdd.getNumPartitions() > 3
    assert placed.write_rows(ordered, "v", f"{tmp_path}/x", b"HEAD\n") == 5000
    want = [str(i) for i in sorted(range(5000), key=lambda i: i * 7919 % 5003)]
    assert (tmp_path / "x").read_text().split("\n") == ["HEAD", *want, ""]
    assert placed.write_rows(ordered.limit(0), "v", f"{tmp_path}/empty") == 0 and (tmp_path / "empty").read_bytes() == b""
    assert sorted(p.name for p in tmp_path.iterdir()) == ["empty", "x"]


def test_plink_set(spark, tmp_path):
    df, g = panel(spark)
    names = [f"id{i}" for i in range(11)]
    structure = spark.createDataFrame([(5,), (90,), (33,)], "variant_index long")
    made = plink.write_plink(df, names, {"INC": list(range(11)), "SEV": [0.25] * 11}, f"{tmp_path}/set", structure)
    assert made["bed_bytes"] == 3 + 97 * 3 and made["variants"] == 97 and made["checked"][0] == 0 and made["checked"][-1] == 96 and len(made["checked"]) == 12
    back = plink.read_bed(spark, f"{tmp_path}/set.bed", 11, task_bytes=30).orderBy("variant_index").collect()
    assert (np.array([r["dosages"] for r in back]) == g).all()
    bim = [x.split("\t") for x in (tmp_path / "set.bim").read_text().splitlines()]
    assert bim == [[str(i % 10 + 1), f"G{i + 1:09d}", "0", str(100 * i), "A", "G"] for i in range(97)]
    for c in range(1, 11):
        assert (tmp_path / f"set.chr{c}_snps.txt").read_text().splitlines() == [f"G{i + 1:09d}" for i in range(97) if i % 10 + 1 == c]
    assert sum(made["chromosomes"].values()) == 97
    assert (tmp_path / "set.structure_snps.txt").read_text() == "G000000006\nG000000034\nG000000091\n"
    assert (tmp_path / "set.SEV.fam").read_text().splitlines()[2] == "id2 id2 0 0 0 0.25"


def test_plink_inputs_that_stop(spark, tmp_path):
    df, _ = panel(spark, 20)
    names = [f"id{i}" for i in range(11)]
    for geno, values in ((df.filter("variant_index <> 7"), [0.0] * 11), (df, [0.0] * 10), (df, [float("nan")] * 11), (df.withColumn("dosages", F.slice("dosages", 1, 5)), [0.0] * 11)):
        with pytest.raises(ValueError):
            plink.write_plink(geno, names, {"T": values}, f"{tmp_path}/bad")
    assert not [p for p in tmp_path.iterdir() if p.suffix in (".bed", ".bim")]


def test_rescan_of_candidates(spark):
    df, g = panel(spark, 60, 30, seed=5)
    rng = np.random.default_rng(6)
    traits = {t: rng.normal(size=30) for t in ("INC", "SEV")}
    omitted = {place: {t: y + 0.3 * rng.normal(size=30) for t, y in traits.items()} for place in ("A b", "C")}
    spectrum = kinship.spectra(df)
    scan = {(r["variant_index"], r["trait"]): r for r in models.mixed_scan(df, traits, mode="score", spectrum=spectrum).collect()}
    rows = [(i, f"S{i}", scan[i, "INC"]["p_score"], scan[i, "SEV"]["p_score"]) for i in (3, 17, 41)]
    candidates = spark.createDataFrame(rows, "variant_index long, lead_snp string, p_INC_score double, p_SEV_score double")
    primary, rest = models.rescan_candidates(df, candidates, traits, omitted, spectrum=spectrum)
    for r in primary.collect():
        assert (r["beta"], r["p_score"]) == pytest.approx((scan[r["variant_index"], r["trait"]]["beta"], scan[r["variant_index"], r["trait"]]["p_score"]), rel=1e-9)
    for place, own in omitted.items():
        whole = {(r["variant_index"], r["trait"]): r for r in models.mixed_scan(df, own, mode="score", spectrum=spectrum).collect()}
        for r in rest.filter(F.col("omitted_location") == place).collect():
            for t in traits:
                assert (r[f"beta_{t}_score"], r[f"p_{t}_score"]) == pytest.approx((whole[r["variant_index"], t]["beta"], whole[r["variant_index"], t]["p_score"]), rel=1e-9)
    effects = tables.candidate_score_effects(primary, candidates, rest, 2)
    assert effects.count() == 3 * 2 * 2
    with pytest.raises(ValueError):
        models.rescan_candidates(df, candidates.union(candidates), traits, omitted, spectrum=spectrum)


def test_power_needs_sound_inputs():
    for n, maf, alpha in ((2, 0.5, 0.05), (100, 0.0, 0.05), (100, 0.6, 0.05), (100, 0.2, 0.0), (100, 0.2, 1.0)):
        with pytest.raises(ValueError):
            models.power(1.0, n, maf, alpha)
    for target in (0.0, 1.0):
        with pytest.raises(ValueError):
            models.detectable_beta(100, 0.2, 0.05, target)
