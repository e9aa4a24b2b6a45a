import hashlib
import math
import tarfile
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from kgspark.llm import media


@given(st.binary(max_size=500))
def test_images_are_lossless(raw):
    payload, n = media.decode(media.encode(raw))
    assert payload == media.padded(raw) and n == len(raw) and len(payload) % 64 == 0 < len(payload)


def plain_feature(payload):
    """The feature without numpy."""
    n = len(payload)
    mean = sum(payload) / n
    dev = (sum((b - mean) ** 2 for b in payload) / n) ** 0.5
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(payload).values())
    bits = "".join("1" if sum(payload[i::64]) / (n // 64) > mean else "0" for i in range(64))
    return mean, dev, abs(entropy), f"{int(bits, 2):016x}"


def test_query_columns(spark, odd, local, tmp_path):
    """All columns against the texts, and the stored form against the files themselves, read by tarfile."""
    rows = media.described(media.media_column(odd, f"file://{tmp_path}/a")).collect()
    stored = {}
    for path in (tmp_path / "a").glob("*.tar"):
        with tarfile.open(path) as t:
            for m in t.getmembers():
                data = t.extractfile(m).read()
                stored[hashlib.sha256(data).hexdigest()] = data
    want = Counter()
    for r in local:
        raw = (r["text"] or "").encode()
        p = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        want[(r["doc_id"], len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows) == want
    for r in rows:
        data = stored[r["media_sha256"]]
        payload, _ = media.decode(data)
        assert r["media_bytes"] == len(data) and hashlib.sha256(payload).hexdigest() == r["payload_sha256"]
        got = dict(x.split("=") for x in r["feature"].split(";"))
        mean, dev, entropy, columns = plain_feature(payload)
        assert got["columns"] == columns and all(abs(float(got[k]) - v) < 1e-4 for k, v in (("mean", mean), ("dev", dev), ("entropy", entropy)))


def test_files_of_lost_attempts_do_not_count(odd, tmp_path):
    uri = f"file://{tmp_path}/lost"
    n = media.write_archives(odd, uri)
    stray = media.Archive(uri, "part-000000-9-dead")
    stray.add("1.png", media.encode(b"again"))
    stray.close()
    reader = media.ArchiveReader({"path": uri})
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == n == odd.count()


def test_ranges_are_bounded(odd, tmp_path, monkeypatch):
    uri = f"file://{tmp_path}/many"
    media.write_archives(odd, uri)
    monkeypatch.setattr(media, "RANGE_BYTES", 600)
    monkeypatch.setattr(media, "MOST_RANGES", 10)
    assert len(media.ArchiveReader({"path": uri}).partitions()) <= 10 + 5


def test_equal_texts_have_equal_values(odd, tmp_path):
    rows = media.described(media.media_column(odd, str(tmp_path / "b"))).filter("doc_id BETWEEN 200 AND 239").collect()
    assert len({tuple(r)[1:] for r in rows}) == 1 and len(rows) == 40


def test_ranges_hold_each_member_once(spark, odd, tmp_path):
    uri = f"file://{tmp_path}/c"
    assert media.write_archives(odd, uri) == odd.count()
    reader = media.ArchiveReader({"path": uri, "rangebytes": "700"})
    parts = reader.partitions()
    assert len(parts) > 20
    names = [n for p in parts for b in reader.read(p) for n in b.column("member").to_pylist()]
    assert len(names) == odd.count()


def test_empty_table_and_folder(spark, none, tmp_path):
    assert media.media_column(none, str(tmp_path / "d")).count() == 0


class Faulty:
    """A file system whose first reads of each offset fail or are cut short."""

    def __init__(self, fs, failures):
        self.fs, self.failures, self.reads = fs, failures, Counter()

    def open_input_file(self, path):
        outer, file = self, self.fs.open_input_file(path)

        class F:
            def read_at(self, n, offset):
                outer.reads[offset] += 1
                if outer.reads[offset] <= outer.failures:
                    if outer.reads[offset] % 2:
                        raise OSError("lost")
                    return file.read_at(n - 5, offset)
                return file.read_at(n, offset)

        return F()


def test_members_are_retried_by_themselves(tmp_path):
    archive = media.Archive(str(tmp_path), "part-0")
    for i in range(3):
        archive.add(f"{i}.png", media.encode(b"x" * i))
    archive.close()
    fs, _ = media.file_system(str(tmp_path))
    faulty = Faulty(fs, 2)
    source = media.Members(faulty, f"{tmp_path}/part-0-00000.tar", attempts=4, pause=0)
    import numpy as np

    index = np.fromfile(tmp_path / "part-0-00000.idx", dtype="<i8").reshape(-1, 2)
    assert [media.decode(source.member(*i.tolist())[1])[1] for i in index] == [0, 1, 2]
    assert set(faulty.reads.values()) == {3}
    with pytest.raises((OSError, ValueError)):
        media.Members(Faulty(fs, 9), f"{tmp_path}/part-0-00000.tar", attempts=3, pause=0).member(*index[0].tolist())


def test_archives_are_plain_tar(tmp_path):
    archive = media.Archive(str(tmp_path), "part-0")
    archive.add("a.png", media.encode(b"hello"))
    archive.close()
    with tarfile.open(tmp_path / "part-0-00000.tar") as t:
        assert media.decode(t.extractfile("a.png").read()) == (media.padded(b"hello"), 5)
    assert pa.__version__
