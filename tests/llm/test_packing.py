import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from catalogspark.llm import bpe, packing
from catalogspark.llm.queries import QUERIES
from tokenizers import Tokenizer


def check(rows, got, length=2048):
    reference = Tokenizer.from_file(bpe.vocabulary_path())
    ids = defaultdict(list)
    for d, t, *_ in rows:
        ids[d].append([*reference.encode(t or "", add_special_tokens=False).ids, 1])
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
        assert r.length > 0
    for d, copies in ids.items():
        assert len({tuple(c) for c in copies}) == 1
        full = copies[0]
        covered = Counter()
        for r in pieces[d]:
            assert r.doc_tokens == len(full) and r.ids_crc32 == zlib.crc32(np.array(full[r.start:r.start + r.length], "<u4").tobytes())
            covered.update(range(r.start, r.start + r.length))
        assert covered == Counter({k: len(copies) for k in range(len(full))})
    assert set(pieces) == set(ids)
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    total = sum(len(c) for v in ids.values() for c in v)
    assert sorted(sequences) == list(range(-(-total // length)))
    return sequences


def test_every_id_lies_in_one_piece(spark, table, fixture_dir, sentences):
    rows = [(i, sentences(i, 1 + i * 7 % 90), "en", ["a", "b", "c", None, ""][i % 5]) for i in range(200)]
    rows += [(500, None), (501, ""), (502, sentences(3, 4000), "en", "big"), (503, sentences(4, 20)), (504, sentences(4, 20))]
    check(rows, QUERIES["op5_mixture_packing"](spark, fixture_dir(table(rows))).collect())


def test_windows_have_the_target_mixture(spark, table, sentences):
    rows = [(i, sentences(i, 60), "en", "a" if i % 4 else "b") for i in range(240)]
    got = packing.pack(table(rows), window=512, length=256, targets={"a": 1.0, "b": 1.0}).collect()
    check(rows, got, 256)
    share = defaultdict(Counter)
    for r in got:
        share[r.sequence_id // 2][r.source] += r.length
    first = [c for w, c in sorted(share.items())][:20]
    assert all(abs(c["a"] - 256) <= 2 and abs(c["b"] - 256) <= 2 for c in first)
    assert set(max(share.items())[1]) == {"a"}


def test_further_sources_share_a_queue(spark, table, sentences):
    rows = [(i, sentences(i, 9), "en", f"s{i % 23}") for i in range(150)] + [(7, sentences(7, 9), "en", "s7")]
    got = packing.pack(table(rows), max_queues=4, window=300, length=128).collect()
    check(rows, got, 128)
    r = got[0]
    assert len(r.ids) == r.length


def mixture(got, per_window):
    share = defaultdict(Counter)
    for r in got:
        share[r.sequence_id // per_window][r.source] += r.length
    return [c for _, c in sorted(share.items())]


def test_more_than_64_sources_keep_their_mixture(spark, table, sentences):
    rows = [(i, sentences(i, 10 + i % 90 // 3), "en", None if i % 90 == 5 else f"s{i % 90}") for i in range(900)]
    got = packing.pack(table(rows), window=2048, length=512, with_ids=False).collect()
    check(rows, got, 512)
    windows, tokens = mixture(got, 4), Counter()
    for c in windows:
        tokens.update(c)
    assert len(tokens) == 90
    # a window may be short by a token a source, so 2048 tokens hold some of the next window's largest sources, which come first
    small = tokens.most_common()[30:]
    for c in windows[:-1]:
        assert c.total() == 2048 and all(abs(c[s] - 2048 * n / tokens.total()) <= 2 for s, n in small)


@pytest.mark.parametrize("most", [None, 4])
def test_targets_of_small_sources_count(spark, table, sentences, most):
    rows = [(i, sentences(i, 12), "en", f"s{i % 80}") for i in range(480)] + [(1000 + i, sentences(i, 6), "en", "few" if i % 2 else "rare") for i in range(16)]
    got = packing.pack(table(rows), window=2048, length=512, targets={"rare": 3.0, "few": 1.0, "absent": 5.0}, max_queues=most, with_ids=False).collect()
    check(rows, got, 512)
    first, tokens = mixture(got, 4)[0], Counter()
    for r in got:
        tokens[r.source] += r.length
    # both together keep their share of all tokens and divide it as the targets say
    both = 2048 * (tokens["rare"] + tokens["few"]) / tokens.total()
    assert both > 20 and abs(first["rare"] - both * 3 / 4) <= 2 and abs(first["few"] - both / 4) <= 2


def test_rare_sources_spread_over_many_windows(spark, table):
    rows = [(i, "many words of one source " * 40, "en", "big") for i in range(40)] + [(100, "few", "en", "rare")]
    got = packing.pack(table(rows), window=64, length=64, with_ids=False).collect()
    check(rows, got, 64)
    at = sorted(r.sequence_id for r in got if r.source == "rare")
    assert len(at) > 1 and at[-1] - at[0] > max(r.sequence_id for r in got) // 3


def test_empty_table(spark, table):
    assert packing.pack(table([(1, "x")]).where("false")).collect() == []


def test_a_new_worker_takes_little_memory():
    code = "import resource as r; from catalogspark.llm import segment as g; peak = lambda: r.getrusage(r.RUSAGE_SELF).ru_maxrss; a = peak(); n = g.classes().sum(); print(peak() - a)"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(packing.__file__).parents[2], capture_output=True, text=True, check=True)
    assert int(done.stdout) < 100_000  # KB; before 240,000
