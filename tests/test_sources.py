import numpy as np
import pytest

from locusframe.operators.guards import join_one_to_one
from locusframe.sources import plink, text_formats, workbooks

VCF = "\n".join(
    [
        "##fileformat=VCFv4.2",
        "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", "a", "b", "c", "d"]),
        "\t".join(["Chr01", "10", ".", "A", "G", ".", ".", ".", "GT:DP", "0/0:3", "0|1:4", "1/1:1", "./.:0"]),
        "\t".join(["1", "20", "named", "A", "G,T", ".", ".", ".", "GT", "0/0", "0/1", "1/1", "0/0"]),
        "\t".join(["scaffold", "30", "x", "A", "G", ".", ".", ".", "GT", "0/0", "0/1", "1/1", "0/0"]),
        "\t".join(["chr10", "bad", "y", "A", "G", ".", ".", ".", "GT", "0/0", "0/1", "1/1", "0/0"]),
        "\t".join(["chr10", "40", "z", "A", "G", ".", ".", ".", "DP:GT", "9:0/1", "9:0/1", "9:1/1", "9:0/0"]),
        "short\t1",
    ]
)


def test_vcf(spark, tmp_path):
    path = tmp_path / "small.vcf"
    path.write_text(VCF + "\n")
    assert text_formats.vcf_samples(spark, str(path)) == ["a", "b", "c", "d"]
    kept, reasons = text_formats.read_vcf(spark, str(path), [0, 1, 2, 3], 0.0, 0.5)
    got = [(r["variant_index"], r["snp"], r["CHR"], r["pos"], list(r["dosages"])) for r in kept.orderBy("variant_index").collect()]
    assert got == [(0, "S01_10", 1, 10, [0, 1, 2, -1]), (1, "z", 10, 40, [1, 1, 2, 0])]
    counts = {r["reason"]: r["count"] for r in reasons.collect()}
    assert counts["kept"] == 2 and sum(counts.values()) == 6


def test_genes(spark, tmp_path):
    path = tmp_path / "genes.gff3"
    path.write_text("##gff\nChr01\ts\tgene\t5\t9\t.\t+\t.\tID=gene:A;Name=first\nChr02\ts\tmRNA\t1\t2\t.\t+\t.\tID=B\nChr02\ts\tgene\tx\t2\t.\t+\t.\tID=C\n")
    assert [(r["CHR"], r["start"], r["end"], r["gene"]) for r in text_formats.read_genes(spark, str(path)).collect()] == [(1, 5, 9, "first")]


def test_bed_codec_and_file(spark, tmp_path):
    row = np.array([[0, 1, 2, -1, 2, 0, 1]], np.int8)
    assert (plink.unpack(plink.pack(row), 7) == row).all()
    rng = np.random.default_rng(3)
    matrix = rng.integers(-1, 3, (10, 5)).astype(np.int8)
    geno = spark.createDataFrame([(i, i % 10 + 1, 100 * i, m.tolist()) for i, m in enumerate(matrix)], "variant_index long, CHR int, pos long, dosages array<tinyint>")
    prefix = str(tmp_path / "set")
    plink.write_plink(geno, list("abcde"), {"INC": [0.5, 1, 2, 3, 4]}, prefix)
    assert (tmp_path / "set.bed").stat().st_size == 3 + 10 * 2
    back = plink.read_bed(spark, prefix + ".bed", 5).orderBy("variant_index").collect()
    assert (np.array([r["dosages"] for r in back]) == matrix).all()
    assert len((tmp_path / "set.bim").read_text().splitlines()) == 10
    with pytest.raises(ValueError):
        plink.pack(np.array([[3]], np.int8))


def test_association_output(spark, tmp_path):
    path = tmp_path / "out.assoc.txt"
    path.write_text("chr rs ps beta se p_wald\n1 G000000000 5 0.5 0.1 0\n1 G000000001 6 nan 0.2 0.25\n")
    got = [(r["rs"], r["beta"], r["p_wald"]) for r in text_formats.read_assoc(spark, str(path)).orderBy("rs").collect()]
    assert got == [("G000000000", 0.5, 1e-300), ("G000000001", None, 0.25)]


def test_workbook_round_trip(spark, tmp_path):
    path = str(tmp_path / "book.xlsx")
    workbooks.write_workbook(path, {"one": spark.createDataFrame([(1, "a<b", 2.5), (2, None, -1.0)], "k int, s string, x double")})
    assert workbooks.read_workbook(path)["one"] == [["k", "s", "x"], ["1", "a<b", "2.5"], ["2", "", "-1.0"]]


def test_join_stops_at_lost_and_repeated_keys(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    with pytest.raises(ValueError):
        join_one_to_one(left, right, "k", "lost")
    with pytest.raises(ValueError):
        join_one_to_one(left.union(left), right, "k", "repeated")


def test_bed_by_ranges(spark, tmp_path):
    matrix = np.random.default_rng(4).integers(-1, 3, (23, 9)).astype(np.int8)
    path = tmp_path / "x.bed"
    path.write_bytes(plink.MAGIC + plink.pack(matrix).tobytes())
    for size in (1, 7, 1000):  # bytes a task: one row, two, all
        d = plink.read_bed(spark, str(path), 9, size)
        assert (np.array([r["dosages"] for r in d.orderBy("variant_index").collect()]) == matrix).all()
    assert plink.read_bed(spark, path.as_uri(), 9).count() == 23
    for samples in (0, 13):
        with pytest.raises(ValueError):
            plink.read_bed(spark, str(path), samples)
    path.write_bytes(plink.MAGIC)
    assert plink.read_bed(spark, str(path), 9).count() == 0


def test_field_books(spark):
    grid = [["", "", "", "LB", ""], ["Plot", "Line", "Plants", "Inc %", "Sev"], ["1001", "A", "10", "50", "2"], ["x", "B", "9", "1", "1"], ["2003", " C ", "8", "", "3"], ["2004", "", "8", "1", "3"]]
    got = workbooks.numbered_plots_book(spark, grid, "here", "land").orderBy("Plot").collect()
    assert [(r["Rep"], r["Cultivar_raw"], r["Plants"], r["INC_raw_source"], r["SEV_raw_source"], r["Location"], r["Country"]) for r in got] == [(1, "A", 10, 50, 2, "here", "land"), (2, "C", 8, None, 3, "here", "land")]
    head = [["", "", "", "", "", "LB", ""], ["Rep", "Block", "Plot", "Entry", "Plants", "Inc", "Sev"]]
    book = {k: [[place, "", "", "", "", "", ""], *head, ["1", "2", plot, "A", "5", "10", "1"]] for k, place, plot in (("s", "East", "7"), ("t", "West", ""))}
    got = workbooks.sheets_book(spark, book, ("east", "west"), "land").orderBy("row").collect()
    assert [(r["Location"], r["Rep"], r["Block"], r["Plot"], r["INC_raw_source"]) for r in got] == [("East", 1, 2, 7, 10), ("West", 1, 2, None, 10)]
    with pytest.raises(ValueError):
        workbooks.sheets_book(spark, book, ("east",), "land")
    fixed = [["Cultivar", "LB-Incidence", "LB-Severity", "Location", "Country", "Year"], [" A1 ", "5", "x", " East ", "land", "2022"]]
    r = workbooks.corrected_book(spark, fixed).first()
    assert (r["Cultivar"], r["INC"], r["SEV"], r["Location"], r["Year"]) == ("A1", 5, None, "East", 2022)


def test_samples_are_matched_in_the_order_of_ids(spark):
    got = text_formats.match_samples(spark, ["B2", "A1", "C3"], ["C3", "A1", "D4"], 2).collect()
    assert [(r["sample_index"], r["VCF_sample"], r["VCF_sample_index"]) for r in got] == [(0, "C3", 2), (1, "A1", 1)]
    for samples, least in ((["A1", "A1"], 1), (["A1"], 2)):
        with pytest.raises(ValueError):
            text_formats.match_samples(spark, samples, ["A1", "C3"], least)


def test_scans_matrices_and_inventories(spark, tmp_path):
    scans = spark.createDataFrame([(1, 0.5, "loco", "INC"), (2, 1e-300, "loco", "SEV")], "variant_index long, p double, context string, trait string")
    text_formats.write_scans(scans, str(tmp_path / "scans"))
    back = text_formats.read_scans(spark, str(tmp_path / "scans"), "variant_index long, p double, context string, trait string")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, scans.collect()))
    k = np.array([[2.0, 0.5], [0.5, 1.0]])
    plink.kinship_text(k, str(tmp_path / "k.txt"), loco=True)
    assert np.allclose(np.loadtxt(tmp_path / "k.txt"), k, atol=1e-12)
    for bad in (np.array([[1.0, 0.1], [0.0, 1.0]]), np.array([[0.0, 1.0], [1.0, 0.0]])):
        with pytest.raises(ValueError):
            plink.kinship_text(bad, str(tmp_path / "bad.txt"))
    plink.covariate_text(np.array([[3.0, 4.0], [5.0, 6.0]]), 1, str(tmp_path / "c.txt"))
    assert np.loadtxt(tmp_path / "c.txt").tolist() == [[1, 3], [1, 5]]
    (tmp_path / "files").mkdir()
    for name in ("a", "b"):
        (tmp_path / "files" / name).write_text(name)
    found = text_formats.file_digests(spark, str(tmp_path / "files"))
    listed = spark.createDataFrame([(r["path"], r["sha256"].lower() if r["path"].endswith("a") else "0") for r in found.collect()] + [("gone", "1")], "path string, sha256 string")
    assert {r["path"].rsplit("/")[-1]: r["state"] for r in text_formats.compare_inventories(listed, found).collect()} == {"b": "changed", "gone": "missing"}
