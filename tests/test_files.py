"""Many small files: they are listed and read by tasks whose number does not grow with theirs."""

import pathlib

from doctree.sources import files, scratch


def some_files(tmp_path):
    for k in range(600):
        at = tmp_path / f"part-{k % 7}" / ("deep" if k % 3 else ".")
        at.mkdir(parents=True, exist_ok=True)
        (at / f"{k} é_structure.json").write_text(f'{{"doc_id": "{k}",\n"doc_name": "n{k}", "structure": []}}')
    (tmp_path / "top_structure.json").write_text('{"doc_name": "top", "structure": []}')
    (tmp_path / "broken.json").write_text('{"doc_name": "x", "structure": [')
    (tmp_path / "odd.txt").write_bytes(b"\xff\xfe")
    for hidden in ("_SUCCESS", ".x.crc", "_staging-1/a.json", ".git/b.json"):
        (tmp_path / hidden).parent.mkdir(exist_ok=True)
        (tmp_path / hidden).write_text('{"doc_name": "hidden", "structure": []}')


def test_small_files_are_read_once_by_few_tasks(spark, tmp_path):
    some_files(tmp_path)
    path = f"file://{tmp_path}"
    shared = pathlib.Path(scratch.shared_dir(spark).removeprefix("file://"))
    before = set(shared.iterdir()) if shared.exists() else set()
    index = files.read_index(spark, path, a_file_each=True)
    assert {r.doc_id for r in index.collect()} == {*map(str, range(600)), "top"} and index.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert len(set(shared.iterdir()) - before) == 1
    plain = files.parse_index(spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True))
    assert sorted(index.collect()) == sorted(plain.collect())


def test_files_are_listed_as_spark_lists_them(spark, tmp_path):
    some_files(tmp_path)
    for glob in ("*.json", "*", "? é_*", "{a,b}*"):
        for recursive in (True, False):
            plain = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
            want = sorted((r.path, r.length) for r in plain.load(f"file://{tmp_path}").select("path", "length").collect()) if recursive else None
            got = files.list_sources(spark, f"file://{tmp_path}/", glob, "out", recursive)
            if recursive:
                assert [(r.path, r.bytes) for r in got.collect()] == want
            else:
                assert {r.name for r in got.collect()} == {"*.json": {"top_structure.json", "broken.json"}, "*": {"top_structure.json", "broken.json", "odd.txt"}, "{a,b}*": {"broken.json"}}.get(glob, set())
    assert files.list_sources(spark, f"file://{tmp_path}", "*.json", recursive=True).rdd.getNumPartitions() < 60


def test_paths_without_a_scheme_are_read_by_tasks_too(spark, tmp_path):
    some_files(tmp_path)
    index = files.read_index(spark, str(tmp_path), a_file_each=True)
    assert {r.doc_id for r in index.collect()} == {*map(str, range(600)), "top"}
    assert len(index.inputFiles()) <= 4 * spark.sparkContext.defaultParallelism


def test_paths_without_a_scheme_are_listed_by_tasks_too(spark, tmp_path):
    some_files(tmp_path)
    found = files.list_sources(spark, str(tmp_path), "*.json", "out", recursive=True)
    assert found.inputFiles() == [] and found.count() == 602
    assert found.collect() == files.list_sources(spark, f"file:{tmp_path}", "*.json", "out", recursive=True).collect()


def test_paths_without_a_scheme_and_with_signs_are_written_and_read(spark, tmp_path):
    docs = spark.createDataFrame([("1", "one", "[]"), ("2", "two", "[]")], "doc_id string, doc_name string, structure_json string")
    for name in ("a b%20c", "#d"):
        for path in (f"{tmp_path}/{name}", f"file://{tmp_path}/{name}-2"):
            files.write_index(docs, path, a_file_each=True)
            assert sorted(r.doc_id for r in files.read_index(spark, path, a_file_each=True).collect()) == ["1", "2"]
    assert {p.name for p in tmp_path.iterdir()} == {"a b%20c", "a b%20c-2", "#d", "#d-2"}
