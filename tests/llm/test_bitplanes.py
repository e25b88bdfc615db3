import zlib

import numpy as np
import pytest
from pyarrow import fs

from quillmerge.llm import bitplanes
from quillmerge.llm.queries import WORDS, vocabulary


@pytest.mark.parametrize("top", [1, 2, 1 << 12, 1 << 16, 1 << 20, 1 << 32])
def test_planes_round_trip(top):
    r = np.random.default_rng(top)
    for n in (1, 7, 1000):
        ids = r.integers(0, top, n).astype(np.uint32)
        kind, planes = bitplanes.to_planes(ids)
        assert (bitplanes.from_planes(kind, planes, n) == ids).all()


def test_file_round_trip(tmp_path):
    r = np.random.default_rng(3)
    docs = [(k, r.integers(0, 50_000, n).astype(np.uint32)) for k, n in enumerate([0, 5, 70_000, 1, bitplanes.BLOCK, 200_000, 0])]
    store = fs.LocalFileSystem()
    with store.open_output_stream(f"{tmp_path}/x.qmbp") as out:
        w = bitplanes.Writer(out)
        for k, ids in docs[:3]:
            w.add([k], [len(ids)], ids)
        w.add([k for k, _ in docs[3:]], [len(x) for _, x in docs[3:]], np.concatenate([x for _, x in docs[3:]]))
        assert w.close() == sum(len(x) for _, x in docs)
    with store.open_input_file(f"{tmp_path}/x.qmbp") as file:
        for (k, ids), (j, got) in zip(docs, bitplanes.read_ids(file), strict=True):
            assert k == j and (ids == got).all()
    with store.open_input_file(f"{tmp_path}/x.qmbp") as file:
        foot = bitplanes.read_footer(file)
        assert sum(c["n"] for c in foot["chunks"]) == sum(foot["lengths"])


def test_query_matches_the_library(spark, tmp_path, docs_of, prose):
    from tokenizers import Tokenizer

    from quillmerge.llm import queries

    rows = [(k * 3 % 40, prose(k, 50)) for k in range(40)]
    rows += [(100, None), (101, ""), (102, "don't! x's. <|endoftext|>. a.b?  12.5,7!! \x1c é́ ’s ΣΑΣ İ"), (5, "again"), (103, "w" * 3000)]
    docs_of(rows).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    tok, at, want = Tokenizer.from_file(vocabulary(WORDS)), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = queries.op3_bitplanes(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_empty_table(docs_of):
    files = bitplanes.write_tokens(docs_of([]), vocabulary(WORDS), end_id=1)
    assert bitplanes.read_documents(files).count() == 0
