"""Files cut into many blocks, against readers that go through them character by character."""

import hashlib
import json
import random

import pytest

from quirecheck.sources import files as I, records
from tests.support import session


def plain_csv(text):
    """Cell by cell: a quote opens a cell that is empty so far, and a doubled quote inside stands for one."""
    rows, row, cell, quoted, i = [], [], "", False, 0
    while i < len(text):
        c = text[i]
        if quoted:
            if c == '"' and text[i + 1 : i + 2] == '"':
                cell, i = cell + '"', i + 1
            elif c == '"':
                quoted = False
            else:
                cell += c
        elif c == '"' and not cell:
            quoted = True
        elif c in ",\n":
            row, cell = row + [cell], ""
            if c == "\n":
                rows, row = rows + ([row] if row != [""] else []), []
        elif c != "\r":
            cell += c
        i += 1
    return rows + ([row + [cell]] if cell or row else [])


@pytest.fixture(params=["128m", "200b", "64b"])
def blocks(request):
    spark = session()
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def random_csv(rng, rows):
    cells = ["a", "", "é", "x" * 70, "two words", 'q"uote', "1.50"]
    quoted = ["", "a,b", "line\nbreak", 'a ""word""', "\n\n", '""', "\r\n", "," * 9, "long\n" * 20]
    cell = lambda: rng.choice(cells) if rng.random() < 0.6 else f'"{rng.choice(quoted)}"' + rng.choice(["", "", "tail"])
    return "".join(",".join(cell() for _ in range(rng.randrange(1, 5))) + rng.choice(["\n", "\r\n", "\n\n"]) for _ in range(rows))


def test_csv_equals_a_plain_reader(blocks, tmp_path):
    rng = random.Random(3)
    for n, text in enumerate([random_csv(rng, 60), random_csv(rng, 3) + '"left open, and\nmore', '"' + "inside\n" * 100 + '",end', "\n\n", "one", '"""a"""\n', random_csv(rng, 10).rstrip("\n")]):
        path = tmp_path / f"t{n}.csv"
        path.write_text(text, newline="")
        rows = I.load_dataset_csv(blocks, str(path)).orderBy("row_no").collect()
        assert [r["cells"] for r in rows] == plain_csv(text), n
        assert [r["row_no"] for r in rows] == list(range(len(rows)))


def test_csv_files_are_numbered_one_after_the_other(blocks, tmp_path):
    rng = random.Random(4)
    texts = [random_csv(rng, 20) for _ in range(4)]
    for i, text in enumerate(texts):
        (tmp_path / f"part{i}.csv").write_text(text, newline="")
    rows = I.load_dataset_csv(blocks, str(tmp_path)).orderBy("row_no").collect()
    assert [r["cells"] for r in rows] == [row for t in texts for row in plain_csv(t)]


def test_large_files_are_read_by_many_tasks(blocks, tmp_path):
    text = random_csv(random.Random(5), 400)
    (tmp_path / "t.csv").write_text(text, newline="")
    size = int(blocks.conf.get("spark.sql.files.maxPartitionBytes")[:-1])
    found = records.pieces(blocks, str(tmp_path / "t.csv"), "\n")
    assert found.rdd.getNumPartitions() >= (len(text) // size if size > 128 or size == 64 else 1)


def plain_json(text):
    items = json.loads(text, parse_float=str, parse_int=str)
    if not items:
        return []
    value = lambda v: "" if v is None else str(v).lower() if isinstance(v, bool) else v
    if isinstance(items[0], dict):
        return [list(items[0])] + [[value(x.get(k)) for k in items[0]] for x in items]
    return [[value(v) for v in x] for x in items]


@pytest.mark.parametrize("indent", [None, 2])
def test_json_equals_a_plain_reader(blocks, tmp_path, indent):
    rng = random.Random(6)
    value = lambda: rng.choice(["a", "", "x,y", '"', "[{", "}],", "\\", "é\n", "k" * 50, None, True])
    objects = [{k: value() for k in ("a", "b,c", 'd"[') if i == 0 or rng.random() < 0.8} for i in range(50)]
    for n, items in enumerate([objects, [[value() for _ in range(rng.randrange(4))] for _ in range(50)], [], [{"a": "1"}], [["x"]]]):
        text = json.dumps(items, indent=indent, ensure_ascii=bool(n % 2))
        text = text.replace('"k"', "2.50")
        (tmp_path / f"t{n}.json").write_text("\n " + text + "\n", newline="")
        rows = I.load_dataset_json(blocks, str(tmp_path / f"t{n}.json")).orderBy("row_no").collect()
        assert [r["cells"] for r in rows] == plain_json(text), n
        assert not any(r["error"] for r in rows)


def test_json_numbers_and_wrong_rows(blocks, tmp_path):
    (tmp_path / "t.json").write_text('[{"a": 2.50, "b": -1e3}, {"b": 7}, ["x"], 5]')
    rows = I.load_dataset_json(blocks, str(tmp_path)).orderBy("row_no").collect()
    assert [r["cells"] for r in rows] == [["a", "b"], ["2.50", "-1e3"], ["", "7"], None, None]
    assert [r["error"] for r in rows][3:] == ["row 3 is an array, but the first row was an object", "row 4 is neither, but the first row was an object"]


def test_scanned_files_share_folders(monkeypatch, tmp_path):
    from quirecheck.plans import reports

    monkeypatch.setattr(reports, "scratch_path", lambda spark, name: f"file:{tmp_path}/{name}")
    found = reports.scan_files(session(), "/root/testdata/sf0.001").collect()
    written = [p for p in tmp_path.rglob("*") if p.is_file() and not p.name.startswith(".")]
    assert len(found) == len(written) == len({r["doc_id"] for r in found})
    assert len({p.parent for p in written}) <= 2  # one for each document before, moved one by one by the driver
    assert all(r["size"] == (tmp_path / "files" / str(r["doc_id"] // 1000) / f"doc_id={r['doc_id']}.txt").stat().st_size for r in found)


def test_json_files_share_folders(monkeypatch, tmp_path):
    from quirecheck.plans import reports

    monkeypatch.setattr(reports, "scratch_path", lambda spark, name: f"file:{tmp_path}/{name}")
    found = reports.load_dataset_json(session(), "/root/testdata/sf0.001").collect()
    written = [p for p in (tmp_path / "table-json").rglob("part=*") if p.is_file()]
    assert len(written) == sum(r["c1"] == "c1" for r in found) > 1
    assert len({p.parent for p in written}) == 1  # one for each file before, moved one by one by the driver


def test_scanned_files_are_listed_by_tasks(tmp_path):
    spark = session()
    for name in ("a.txt", "b.csv", ".h.txt", "_h.txt", "k=1/c.txt", "k=1/_x/d.txt", "sub/é %20.txt", "sub/deep/e.txt", "sub/deep/empty.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"" if "empty" in name else name.encode() * 300_000)

    def plain(pattern, recursive):
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(str(tmp_path))
        return sorted(map(tuple, files.selectExpr("path", "length", "sha2(content, 256)").collect()))

    for pattern in ("*", "*.txt", "{a,c}.*", "[^ab]*.txt"):
        found = I.scan_files(spark, str(tmp_path), pattern)
        # Spark's reader passes over files of no bytes.
        empty = [(f"file:{tmp_path}/sub/deep/empty.txt", 0, hashlib.sha256().hexdigest())] if pattern != "{a,c}.*" else []
        assert sorted(map(tuple, found.collect())) == sorted(plain(pattern, "true") + empty)
        assert not [f for f in found.inputFiles() if f.endswith((".txt", ".csv"))]  # all of them before, on the driver
    assert [r["path"] for r in I.scan_files(spark, str(tmp_path / "a.txt")).collect()] == [f"file:{tmp_path}/a.txt"]
    (tmp_path / "none").mkdir()
    assert I.scan_files(spark, f"file:{tmp_path}/none").count() == 0
    with pytest.raises(Exception, match="missing"):
        I.scan_files(spark, str(tmp_path / "missing"))
