import hashlib
import itertools
import json
import os
import pickle

import pytest

from quern.functions import codecs
from quern.plans import binary
from quern.sources import archive


def _read(path, data, *cuts):
    ends = [0, *cuts, len(data)]
    return [r["slot"] for a, b in zip(ends, ends[1:]) for r in archive.read_range(archive.Range(str(path), a, b), archive.Wanted(kinds={0}))]


def _tx(slot, size=1):
    return archive.section(codecs.cbor_encode([archive.TRANSACTION, archive.frame(hashlib.sha256(b"%d" % slot).digest() * size), archive.frame(b""), slot, 0]))


def _block(slot):
    return archive.section(codecs.cbor_encode([archive.BLOCK, slot, [], [], [slot - 1, slot, None], codecs.Link(b"r")]))


def test_damage_before_a_size_that_ends_at_a_section_by_chance(tmp_path):
    """The last damaged byte and the next section's size together are a size too, and a section begins just where that one would end."""
    lost = _tx(2, 10)
    size, width = codecs.varint_decode(lost[:10])
    assert width == 2
    wrong, _ = codecs.varint_decode(b"\xff" + lost[:2])
    within = lost + _tx(3, 30)
    room = wrong - (len(within) - width)
    fill = _tx(4, room // 32 - 20)
    pad = room - len(fill)
    # a section of exactly the room that is left: its size has two bytes
    last = archive.section(b"\x80" * (pad - 2 - 36))
    assert len(last) == pad
    data = archive.archive([]) + _tx(1) + _block(1) + b"\xff" * 12 + within + fill + last + _tx(5) + _block(2)
    assert archive._sound(data, data.index(lost) - 1 + 3 + wrong, len(data))
    (path := tmp_path / "a.car").write_bytes(data)
    assert _read(path, data) == [1, 2, 3, 4, 5]


def test_a_range_starts_at_a_block_that_damage_follows(tmp_path):
    """The group after the damage belongs to the range in which the block before it begins, wherever the cut is."""
    data = archive.archive([])
    for slot in range(1, 6):
        data += _tx(slot * 10) + _tx(slot * 10 + 1) + _block(slot) + b"\xff" * 12
    (path := tmp_path / "a.car").write_bytes(data)
    for cut in range(1, len(data)):
        assert _read(path, data, cut) == [s * 10 + k for s in range(1, 6) for k in (0, 1)], cut


def test_parts_written_side_by_side_are_the_archive_in_order(spark, sf_dir, tmp_path, monkeypatch):
    """Many tasks write parts of one file: the same bytes as block after block, damage after every fifth block of the whole, and no part is left."""
    monkeypatch.setattr(binary, "PART_ROWS", 100)
    rows = sorted((r.o_orderkey, r.o_custkey, r.o_totalprice) for r in spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice").collect())
    whole, cids = archive.archive([]), []
    for number, own in itertools.groupby(rows, lambda r: r[0] // 100):
        sections, cid = binary._block_sections(number, list(own))
        cids.append(cid)
        whole += sections + (b"\xff" * 12 if len(cids) % 5 == 0 else b"")
    subset = codecs.cbor_encode([archive.SUBSET, 0, rows[-1][0] // 100, [codecs.Link(c) for c in cids[:3]]])
    whole += archive.section(subset) + archive.section(codecs.cbor_encode([archive.EPOCH, 7, [codecs.Link(archive.node_id(subset))]]))
    folder = binary._write_archive(spark, sf_dir, str(tmp_path / "car"), damage=True)
    assert len(cids) > 10 and os.listdir(folder) == ["epoch-7.car"] and (tmp_path / "car" / "epoch-7.car").read_bytes() == whole


def test_small_ranges_are_bounded_and_numbers_stay_with_the_planner(tmp_path):
    with open(tmp_path / "epoch-9.car", "wb") as f:
        f.truncate(4 << 30)
    bases = {f"{tmp_path}/epoch-9.car:{r.start}": (1, 2) for r in archive.ArchiveReader({"path": str(tmp_path), "splitbytes": "262144"}).partitions()}
    source = archive.ArchiveSource({"path": str(tmp_path), "splitBytes": "262144", "bases": json.dumps(bases)})
    reader = source.reader(None)
    parts = reader.partitions()
    assert 150 <= len(parts) <= 201 and {p.base for p in parts} == {(1, 2)}
    assert [p.start for p in parts[1:]] == [p.end for p in parts[:-1]] and (parts[0].start, parts[-1].end) == (0, 4 << 30)
    assert len(pickle.dumps(reader)) + len(pickle.dumps(source)) < 3000


@pytest.mark.parametrize("name", ["car_scan", "car_nodes", "car_kind_pushdown", "car_recover", "node_counters"])
def test_nothing_is_counted_for_numbers_nobody_asks_for(spark, sf_dir, monkeypatch, name):
    asked = []
    read = archive.read_archives
    monkeypatch.setattr(archive, "read_archives", lambda *a, **k: asked.append(k.get("numbered", True) and {"group_id", "pos"} & {*(k.get("columns") or (a[3] if len(a) > 3 else ["pos"]))}) or read(*a, **k))
    binary.QUERIES[name](spark, sf_dir)
    assert len(asked) == 1 and not asked[0]
