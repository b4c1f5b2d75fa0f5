"""Sources and sinks that write or read whole files: round trips and refusals."""

import hashlib
import io
import json
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.sources import archives, bundles, plink, tables, text


def read_fileset(folder):
    """(chrom, id, pos, ref, alt, codes by sample) of every part, by a reader of its own."""
    samples = [line.split()[1] for line in (folder / "all.fam").read_text().splitlines()]
    out = []
    for line in (folder / "merge-list.txt").read_text().splitlines():
        bed, bim, fam = (folder / x for x in line.split())
        assert fam.name == "all.fam"
        raw, sites = bed.read_bytes(), [x.split("\t") for x in bim.read_text().splitlines()]
        width = (len(samples) + 3) // 4
        assert raw[:3] == b"\x6c\x1b\x01" and len(raw) == 3 + width * len(sites)
        for k, (chrom, name, zero, pos, ref, alt) in enumerate(sites):
            block = raw[3 + k * width : 3 + (k + 1) * width]
            codes = [block[i // 4] >> 2 * (i % 4) & 3 for i in range(len(samples))]
            assert zero == "0" and all(block[-1] >> 2 * j & 3 == 0 for j in range(len(samples) % 4 or 4, 4))
            out.append((chrom, name, int(pos), ref, alt, dict(zip(samples, codes))))
    return samples, out


def test_plink_filesets(spark, tmp_path):
    r = random.Random(1)
    codes = {"hom_ref": 0, "het": 2, "hom_alt": 3}
    rows, want = [], {}
    for k in range(300):
        chrom, pos = ("1", "2", "X", "10")[k % 4], k * 10
        calls = {f"s {i}": r.choice([*codes, None]) for i in range(9) if r.random() < 0.7}
        rows += [(s, f"rs{k}" if k % 5 else None, f"chr{chrom}", pos, "a", "G", z) for s, z in calls.items()]
        if any(calls.values()):
            want[chrom, pos] = (f"rs{k}" if k % 5 else f"{chrom}:{pos}", {s.replace(" ", "_"): codes.get(z, 1) for s, z in calls.items()})
    rows += [("s 0", "i1", "3", 1, "AT", "G", "het"), ("s 0", "i2", "3", 2, "A", "A", "het"), ("s 0", "i3", "3", 3, "N", "G", "het")]
    rows += [("s 1", "d1", "3", 4, "A", "G", "het"), ("s 1", "d1", "3", 4, "A", "G", "het"), ("s 1", "d2", "3", 5, "A", "G", "het"), ("s 1", "d3", "3", 5, "A", "G", "het"), ("s 2", "d4", "3", 6, "A", "G", "het"), ("s 3", "d4", "3", 6, "A", "C", "het")]
    want["3", 4] = ("d1", {"s_1": 2})
    df = spark.createDataFrame(rows, "sample_id string, rsid string, chrom string, pos long, ref string, alt string, zygosity string").repartition(3)
    plink.write(df, str(tmp_path / "set"))
    samples, got = read_fileset(tmp_path / "set")
    assert samples == [f"s_{i}" for i in range(9)]
    assert {(c, p): (n, x) for c, n, p, _, _, x in got} == {k: (n, {s: x.get(s, 1) for s in samples}) for k, (n, x) in want.items()}
    order = ["1", "2", "3", "10", "X"]
    assert [(order.index(c), p) for c, _, p, *_ in got] == sorted((order.index(c), p) for c, _, p, *_ in got) and len(got) == len(want)
    assert len(list((tmp_path / "set").glob("*.bed"))) > 1 and not list((tmp_path / "set").glob("_attempt*"))


def test_an_empty_fileset_has_samples_and_no_parts(spark, tmp_path):
    df = spark.createDataFrame([("a", "r", "1", 1, "A", "G", None)], "sample_id string, rsid string, chrom string, pos long, ref string, alt string, zygosity string")
    plink.write(df, str(tmp_path / "set"))
    assert read_fileset(tmp_path / "set") == (["a"], [])


def a_bundle(n=40, k=3, **other):
    r = np.random.default_rng(2)
    own = {
        "loadings": np.asfortranarray(r.random((n, k))), "means": r.random(n), "stds": np.ones(n, np.float32), "eigenvalues": np.arange(k, 0, -1.0), "tw_pvalues": np.zeros(20),
        "aim_rsids": np.array([f"rs{i}" for i in range(n)]), "aim_rsids_23andme": np.array([f"rs{i}" for i in range(n)]), "aim_chroms": np.array(["1"] * n), "aim_positions_grch38": np.arange(n, dtype=np.int32),
        "aim_a1": np.array(["G"] * n), "aim_a2": np.array(["A"] * n), "populations": np.array(["AFR", "EUR"]), "population_centroids": r.random((2, k)), "ref_pca_coords": r.random((7, k)),
        "ref_labels": np.array(["AFR", "EUR"] * 3 + ["EUR"]), "ref_sample_ids": np.array([f"s{i}" for i in range(7)]), "n_significant_pcs": np.array(2), "n_total_snps": np.array(90), "n_selected_aims": np.array(n),
    } | other
    return {name: x for name, x in own.items() if x is not None}


def test_npz_bundles(spark, tmp_path):
    own = a_bundle()
    for save, name in ((np.savez, "plain.npz"), (np.savez_compressed, "packed.npz")):
        path = str(tmp_path / name)
        save(path, **own)
        p = bundles.projection(spark, path)
        got = p.markers.orderBy("pos").collect()
        assert np.allclose([r["load"] for r in got], own["loadings"]) and [r["mean"] for r in got] == list(own["means"]) and (got[3]["rsid"], got[3]["ref"], got[3]["sd"]) == ("rs3", "A", 1.0)
        assert {x: list(map(float, v)) for x, v in zip(own["populations"], own["population_centroids"])} == p.centroids and p.reference.count() == 7
    few = spark.read.format("npz").option("path", path).option("members", "ref_pca_coords,ref_labels").option("rows", "2").load()
    assert few.rdd.getNumPartitions() == 4 and np.allclose([r["ref_pca_coords"] for r in few.orderBy("row").collect()], own["ref_pca_coords"])
    assert few.columns == ["row", "ref_pca_coords", "ref_labels"]


@pytest.mark.parametrize(
    "change",
    [{"extra": np.zeros(2)}, {"means": None}, {"means": np.zeros(39)}, {"loadings": np.zeros(40)}, {"tw_pvalues": np.zeros(19)}, {"population_centroids": np.zeros((2, 4))}, {"ref_labels": np.array(["ZZZ"] * 7)},
     {"aim_rsids_23andme": np.array(["rs1"] * 40)}, {"means": np.full(40, np.nan)}, {"aim_a1": np.array([{}] * 40, dtype=object)}, {"populations": np.array(["EUR", "EUR"])}],
)
def test_npz_bundles_that_are_refused(spark, tmp_path, change):
    path = str(tmp_path / "b.npz")
    np.savez(path, **a_bundle(**change))
    with pytest.raises(bundles.BundleError):
        bundles.projection(spark, path)


def test_tree_bundles(tmp_path):
    snp = {"rsid": "i1", "allele": "G", "pos": 5}
    leaf = {"haplogroup": "H1", "defining_snps": [snp], "children": [], "optional_conflict_snps": [{"rsid": "i2", "allele": "T"}]}
    whole = {"trees": {"mt": {"haplogroup": "L", "defining_snps": [], "children": [leaf]}, "Y": {"haplogroup": "A", "defining_snps": [], "children": []}}}
    path = tmp_path / "t.json"
    path.write_text(json.dumps(whole))
    found = bundles.trees(str(path))
    assert found["mt"].children[0].markers == (("i1", "G"),) and found["mt"].children[0].guards == (("i2", "T"),) and found["Y"].name == "A"
    for bad in ("{", "[]", '{"trees": {"mt": {}}}', json.dumps({"trees": whole["trees"] | {"Y": {"haplogroup": "A", "defining_snps": [{"rsid": "x"}], "children": []}}})):
        path.write_text(bad)
        with pytest.raises(bundles.BundleError):
            bundles.trees(str(path))


A = "# This data file generated by 23andMe\n# build 37\n# rsid\tchromosome\tposition\tgenotype\n"


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(name.replace("_", "."), data)
    return out.getvalue()


def lying(data):
    """An archive whose headers say that its file has 5 bytes."""
    raw, size = bytearray(zipped(a_txt=data)), len(data).to_bytes(4, "little")
    for at in [i for i in range(len(raw)) if raw[i : i + 4] == size]:
        raw[at : at + 4] = (5).to_bytes(4, "little")
    return bytes(raw)


def test_uploads(spark, tmp_path):
    good = (A + "".join(f"rs{i}\t1\t{i}\tAG\n" for i in range(1, 9000)) + "i\xe9\t2\t5\t--\r\nrs9\tX\t7\tA").encode("latin-1")
    b = "#AncestryDNA raw data download\nrsid\tchromosome\tposition\tallele1\tallele2\nrs5\t1\t9\tT\tC\n".encode()
    files = {
        "good.zip": zipped(in_txt=good), "same.txt": good, "b.txt": b, "two.zip": zipped(a_txt=good, b_txt=good), "csv.zip": zipped(a_csv=good), "bomb.zip": zipped(a_txt=A.encode() + b"x" * 3_000_000), "lying.zip": lying(A.encode() + b"\n" * 3_000_000),
        "large.txt": b"#" * 2_000_000, "broken.zip": b"PK\x03\x04binary", "notes.txt": b"hello world\nnot genotype data\n", "binary.txt": b"a\0b", "bad.txt": (A + "rs1\t1\t5\tAG\nrs2\t99\t5\tAG\n").encode(), "old.txt": A.replace("37", "36").encode() + b"rs1\t1\t5\tAG\n", "empty.txt": b"", "none.txt": A.encode(),
    }
    (tmp_path / "in").mkdir()
    for name, data in files.items():
        (tmp_path / "in" / name).write_bytes(data)
    root = str(tmp_path / "store")
    got = {r["path"].rsplit("/", 1)[1]: r for r in archives.ingest(spark, str(tmp_path / "in"), root, "one", most=1_000_000).collect()}
    assert {k: r["reason"] for k, r in got.items()} == {
        "good.zip": None, "same.txt": "known", "b.txt": None, "two.zip": "the archive has to hold one file", "csv.zip": "the archive has to hold a .txt file", "bomb.zip": "too large", "lying.zip": got["lying.zip"]["reason"], "large.txt": "too large",
        "broken.zip": "not a readable archive", "notes.txt": "unknown format", "binary.txt": "a binary file", "bad.txt": "chromosome", "old.txt": "a build 36 file needs a chain", "none.txt": "no calls",
    }
    assert got["lying.zip"]["reason"] in ("too large", "not a readable archive") and got["lying.zip"]["n_bytes"] <= 1_000_000
    one = got["good.zip"]
    assert (one["name"], one["vendor"], one["version"], one["build"], one["n_variants"], one["n_nocalls"], one["n_bytes"]) == ("in.txt", "a", "v4", "GRCh37", 9001, 1, len(good)) and one["file_hash"] == hashlib.sha256(good).hexdigest()
    calls = archives.committed(spark, root)
    assert calls.count() == 9002 and calls.filter("rsid = 'i�' and genotype = '--'").count() == 1 and calls.filter("genotype = 'CT'").count() == 1
    again = archives.ingest(spark, str(tmp_path / "in" / "good.zip"), root, "two", most=1_000_000).collect()
    assert [r["reason"] for r in again] == ["known"] and archives.committed(spark, root).count() == 9002


def test_a_batch_that_was_broken_off_leaves_nothing(spark, tmp_path, monkeypatch):
    (tmp_path / "a.txt").write_bytes((A + "rs1\t1\t5\tAG\n").encode())
    root, write = str(tmp_path / "store"), archives.publish

    def broken(df, folder, name):
        if folder.endswith("files"):
            raise KeyboardInterrupt
        return write(df, folder, name)

    monkeypatch.setattr(archives, "publish", broken)
    with pytest.raises(KeyboardInterrupt):
        archives.ingest(spark, str(tmp_path / "a.txt"), root, "one")
    assert archives.committed(spark, root).count() == 0
    monkeypatch.setattr(archives, "publish", write)
    for _ in range(2):
        archives.ingest(spark, str(tmp_path / "a.txt"), root, "one")
        assert archives.committed(spark, root).count() == 1


def test_tables_by_their_header(spark, tmp_path):
    path = tmp_path / "scores.tsv"
    path.write_text("#CHROM\tother\tPOS\tREF\tALT\tam_pathogenicity\n" + "".join(f"1\tz\t{i % 700}\tA\tG\t{i / 1000}\n" for i in range(1400)) + "1\tz\tx\tA\tG\t0.5\n2\tz\t5\tA\tG\t.\n")
    columns = {"chrom": ("CHROM", "string"), "pos": ("pos", "long"), "ref": ("REF", "string"), "alt": ("ALT", "string"), "score": ("am_pathogenicity", "double")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = tables.load(spark, f"file://{path}", columns, ["chrom", "pos", "ref", "alt"], sep="\t", some=["score"])
        assert {r["pos"]: r["score"] for r in got.collect()} == {i: (i + 700) / 1000 for i in range(700)}  # the last row of a key counts
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    csv = tmp_path / "t.csv"
    csv.write_text("Gene,pLI\nA,0.5\nB,\n,0.1\n")
    assert sorted(map(tuple, tables.load(spark, str(csv), {"gene": ("gene", "string"), "pli": ("PLI", "double")}, ["gene"]).collect())) == [("A", 0.5), ("B", None)]
    for header in ("gene,other\n", "gene,pli,PLI\n"):
        csv.write_text(header)
        with pytest.raises(text.FormatError):
            tables.load(spark, str(csv), {"gene": ("gene", "string"), "pli": ("PLI", "double")}, ["gene"])
