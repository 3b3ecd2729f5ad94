import random
import zlib
from itertools import groupby

import numpy as np
from corpusql.llm.packing import PROBES, Packer, encoder, pack_documents, pack_examples, sequences, tokenizer_file


def padding(lengths, tokens=1024):
    return sum(tokens - n for n in lengths if n & (n - 1))


def test_round_trip_and_no_padding(spark):
    from tokenizers import Tokenizer

    r = random.Random(2)
    texts = [None, "", "a", *PROBES] + [" ".join(r.choice(["the", "Été", "zqxj", "12,5", "\n"]) for _ in range(r.choice([3, 40, 700, 5000]))) for _ in range(80)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, "repeated id"), (None, "no id")], "doc_id long, text string").repartition(3)
    rows = pack_documents(docs, tokenizer_file(), with_ids=True).collect()
    t = Tokenizer.from_file(tokenizer_file())
    by_doc = sorted((x for x in rows if x.doc_id), key=lambda x: (x.doc_id, x.start))
    for d, pieces in groupby(by_doc, key=lambda x: x.doc_id):
        pieces, ids = list(pieces), t.encode(texts[d] or "", add_special_tokens=False).ids + [0]
        assert [i for p in pieces for i in p.ids] == ids
        assert all(p.doc_tokens == len(ids) and p.length == len(p.ids) and ids[p.start : p.start + p.length] == p.ids for p in pieces)
        assert all(zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32 for p in pieces)
    assert len({x.doc_id for x in rows}) == len(texts) + 1
    lengths = []
    for _, seq in groupby(sorted(rows, key=lambda x: (x.sequence_id, x.offset)), key=lambda x: x.sequence_id):
        n = 0
        for p in seq:
            assert p.offset == n
            n += p.length
        lengths.append(n)
    assert max(lengths) <= 1024 and padding(lengths) == 0
    assert pack_documents(docs.limit(0), tokenizer_file()).collect() == []


def test_fast_encoder_equals_the_file():
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(tokenizer_file()), encoder(tokenizer_file())
    r = random.Random(1)
    texts = ["".join(chr(r.choice([r.randint(1, 126), r.randint(160, 0x2FF), r.randint(0x4E00, 0x4E20), 0x1F600])) for _ in range(200)) for _ in range(200)]
    assert e(texts) == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_segment_limit_and_small_pool():
    docs = [(i, np.full(3 + i % 5, i, "<u4")) for i in range(500)]
    seqs = list(sequences(iter(docs), tokens=64, segments=4, pool=32))
    assert max(len(s) for s in seqs) <= 4
    got = sorted((p.doc, p.start, len(p.ids)) for s in seqs for p in s)
    assert sum(n for *_, n in got) == sum(len(i) for _, i in docs) and len({d for d, *_ in got}) == 500


def test_dot_product_prefers_what_uses_the_scarce_dimension():
    p = Packer((10, 10))
    for v, name in [((5, 5), "even"), ((9, 1), "long"), ((1, 9), "wide")]:
        p.add(v, name)
    bins = []
    while p.n:
        bins.append(sorted(p.fill()[0]))
    assert ["long", "wide"] in bins and ["even"] in bins


def test_examples_keep_every_limit(spark):
    r = random.Random(4)
    rows = [(i, r.randint(1, 900), r.randint(1, 6), r.randint(0, 500)) for i in range(3000)] + [(3000, 9999, 1, 1), (3001, None, None, None)]
    out = pack_examples(spark.createDataFrame(rows, "example_id long, n_tokens long, n_segments long, n_loss long").coalesce(1)).collect()
    v, bins = {i: [x or 0 for x in v] for i, *v in rows}, {}
    for x in out:
        bins.setdefault(x.bin_id, []).append((x.slot, x.example_id))
    assert sorted(i for b in bins.values() for _, i in b) == list(range(3002))
    assert all([s for s, _ in sorted(b)] == list(range(len(b))) for b in bins.values())
    sums = [np.sum([v[i] for _, i in b], axis=0) for b in bins.values()]
    assert all((s <= (4096, 64, 2048)).all() for s, b in zip(sums, bins.values(), strict=True) if (0, 3000) not in b)
    least = max(np.ceil(np.sum([v[i] for i in range(3000)], axis=0) / (4096, 64, 2048)))
    assert len(bins) <= 1.05 * least + 2


def test_conversations_stay_whole_within_all_limits(spark, tmp_path):
    import random

    from tokenizers import Tokenizer

    from corpusql.llm.packing import conversation_examples, pack_conversations, tokenizer_file

    r, t = random.Random(1), Tokenizer.from_file(tokenizer_file())
    rows = [(c, k, r.choice(["user", "assistant"]), " ".join(["word"] * r.randint(0, 400))) for c in range(80) for k in range(r.randint(1, 9))] + [(200, 0, "assistant", None), (201, 0, None, "x" * 30_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns.repartition(2).write.parquet(f"{tmp_path}/conversations.parquet")
    want = {}
    for c, _, role, x in rows:
        n, s, loss = want.get(c, (0, 0, 0))
        k = len(t.encode(x or "", add_special_tokens=False).ids) + 1
        want[c] = (n + k, s + 1, loss + k * (role == "assistant"))
    assert {x.example_id: (x.n_tokens, x.n_segments, x.n_loss) for x in conversation_examples(turns, tokenizer_file()).collect()} == want
    bins = {}
    out = pack_conversations(spark, str(tmp_path)).collect()
    for x in out:
        bins.setdefault(x.bin_id, []).append(x)
    assert sorted(x.example_id for x in out) == sorted(want)
    for xs in bins.values():
        assert sorted(x.slot for x in xs) == list(range(len(xs)))
        assert len(xs) == 1 or all(sum(want[x.example_id][k] for x in xs) <= limit for k, limit in enumerate((4096, 64, 2048)))
