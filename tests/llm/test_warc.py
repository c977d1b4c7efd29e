import hashlib

from docsift.llm import warc
from docsift.session import scratch_path

SCHEMA = "page_id long, url string, html string, key string, digest string"


def archive(spark, pages, **kw):
    df = spark.createDataFrame([(*p, "x", "y") for p in pages], SCHEMA)
    folder = scratch_path(spark, "warc-test")
    manifest = warc.write_archive(warc.with_digests(df, "page_id", "url", "html"), folder, **kw)
    return folder, manifest


def test_round_trip_revisits_and_cases(spark):
    big, small = "é<p>" * 400, "short"
    pages = [(1, "http://a/", big), (2, "http://b/\r\nX: y", big), (3, None, big), (4, "u", small), (5, "u", small), (6, "u", None),
             (7, "u", ""), (8, "u", "WARC/1.1\r\n\r\n" * 200), (None, "u", big), (3, "u2", big), (9, "u", "x" * 3_000_000)]
    folder, _ = archive(spark, pages)
    got = sorted(((r.key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.html)
                  for r in warc.read_archive(spark, folder).collect()), key=str)
    want = []
    for i, _, h in pages:
        b = (h or "").encode()
        to = 3 if h == big and i is not None and i < 3 else None
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if to else "response", to, None if to else (h or "")))
    assert got == sorted(want, key=str)


def test_deterministic_files_rolled_by_compressed_size(spark):
    import random
    rng = random.Random(4)
    pages = [(i, f"http://h/{i}", "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3000))) for i in range(300)]
    runs = []
    for order in (pages, pages[::-1]):
        folder, manifest = archive(spark, order, shard_bytes=200_000, file_bytes=50_000)
        files = sorted((r.name, r.records, r.bytes, r.sha1) for r in manifest.collect())
        system, root = warc.file_system(folder)
        for name, _, size, sha in files:
            with system.open_input_stream(f"{root}/{name}", compression=None) as f:
                data = f.read()
            assert len(data) == size and hashlib.sha1(data).hexdigest() == sha
            assert size < 50_000 + 4000
        from pyarrow import fs
        held = [x.base_name for x in system.get_file_info(fs.FileSelector(root))]
        assert sorted(held) == sorted([n for n, *_ in files] + ["_manifest"])  # nothing temporary stays
        runs.append(files)
    assert runs[0] == runs[1] and len(runs[0]) > 5


def test_one_key_on_a_third_of_the_rows_is_split(spark):
    pages = [(7 if i % 3 == 0 else i, f"u{i}", f"{i} " * 300) for i in range(600)]
    folder, manifest = archive(spark, pages, shard_bytes=60_000, file_bytes=1 << 20)
    assert max(r.records for r in manifest.collect()) < 200
    assert warc.read_archive(spark, folder).count() == 600


def test_empty_table(spark):
    folder, manifest = archive(spark, [])
    assert manifest.count() == 0 and warc.read_archive(spark, folder).count() == 0
