"""Archives, tiles and extracts written and read again."""

import random

import pytest

from wayloom.sources import osm_pbf, tile_archive, vector_tiles


def test_directory_round_trip():
    entries = [(3, 1, 10, 0), (5, 4, 20, 10), (90, 0, 7, 0), (91, 1, 5, 1000)]
    assert tile_archive.decode_directory(tile_archive.encode_directory(entries)) == entries
    with pytest.raises(ValueError):
        tile_archive.decode_directory(b"\x00")


@pytest.mark.parametrize("leaf", [0, 3])
def test_archive_round_trip(spark, tmp_path, leaf):
    tiles = {i: f"tile {i // 3}".encode() for i in range(21, 60)} | {0: b"top"}
    path = str(tmp_path / "a.pm")
    tile_archive.write_archive(path, tiles, 0, 3, metadata={"name": "x"}, leaf=leaf)
    head, meta = tile_archive.info(path)
    assert (head.addressed, head.maxzoom, meta) == (len(tiles), 3, {"name": "x"})
    spark.dataSource.register(tile_archive.TileArchive)
    got = spark.read.format("tile_archive").option("path", path).load().collect()
    assert {r.tile_id: bytes(r.data) for r in got} == tiles
    assert next((r.z, r.x, r.y) for r in got if r.tile_id == 0) == (0, 0, 0)
    high = spark.read.format("tile_archive").option("path", path).option("minzoom", 3).load()
    assert {r.tile_id for r in high.collect()} == {t for t in tiles if t >= 21}


def test_ranges_of_boxes_hold_exactly_their_tiles():
    for z, box in ((0, (0, 0, 0, 0)), (3, (1, 2, 5, 6)), (4, (0, 0, 15, 15)), (5, (7, 3, 7, 30)), (4, (3, 3, 2, 5))):
        ids = {t for t in range(tile_archive.first_id(z), tile_archive.first_id(z + 1)) if box[0] <= tile_archive.tile_of(t)[1] <= box[2] and box[1] <= tile_archive.tile_of(t)[2] <= box[3]}
        ranges = tile_archive.box_ranges(z, *box)
        assert {t for a, b in ranges for t in range(a, b)} == ids
        assert all(b < c for (_, b), (c, _) in zip(ranges, ranges[1:]))
        assert ids <= {t for a, b in tile_archive.box_ranges(z, *box, most=4) for t in range(a, b)}


class Counted:
    def __init__(self, f, count):
        self.f, self.count = f, count

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.f.close()

    def read_at(self, n, at):
        self.count.append(n)
        return self.f.read_at(n, at)


def test_bytes_read_fall_with_the_box(tmp_path, monkeypatch):
    path, open_, count = str(tmp_path / "b.pm"), tile_archive._open, []
    z = 6
    tiles = {t: bytes(random.Random(t).randbytes(3000)) for t in range(tile_archive.first_id(z), tile_archive.first_id(z + 1))}
    tile_archive.write_archive(path, tiles, z, z, leaf=64)
    monkeypatch.setattr(tile_archive, "_open", lambda p: Counted(open_(p), count))
    read, rows = {}, {}
    for name, box in (("world", None), ("quarter", "0.1,0.1,180,85"), ("one", "10,10,11,11"), ("line", "-180,1,180,2"), ("none", "20,10,10,11")):
        count.clear()
        reader = tile_archive._Reader({"path": path} | ({"bbox": box} if box else {}))
        rows[name] = {r[0]: r[4] for p in reader.partitions() for r in reader.read(p)}
        read[name] = (sum(count), len(count))
    assert rows["world"] == tiles and rows["none"] == {}
    at = {t: tile_archive.tile_of(t) for t in tiles}
    assert rows["quarter"] == {t: d for t, d in tiles.items() if at[t][1] >= 32 and at[t][2] < 32}
    assert rows["line"] == {t: d for t, d in tiles.items() if at[t][2] == 31}
    assert len(rows["one"]) == 1
    assert read["one"][0] < read["line"][0] < read["world"][0] and read["quarter"][0] < 0.3 * read["world"][0]
    assert read["world"][1] < 0.1 * len(tiles)  # neighbours are read at once


@pytest.mark.parametrize("leaf", [0, 16])
def test_bounds_and_lookups(spark, tmp_path, leaf):
    path = str(tmp_path / "c.pm")
    tiles = {t: str(t // 2).encode() for t in range(0, 341) if t % 7}
    tile_archive.write_archive(path, tiles, 0, 4, leaf=leaf)
    at = {t: tile_archive.tile_of(t) for t in tiles}
    spark.dataSource.register(tile_archive.TileArchive)
    read = lambda **o: {r.tile_id: bytes(r.data) for r in spark.read.format("tile_archive").options(path=path, **o).load().collect()}
    assert read(x="1:3", y="2:2", minzoom=3) == {t: d for t, d in tiles.items() if at[t][0] >= 3 and 1 <= at[t][1] <= 3 and at[t][2] == 2}
    assert read(bbox="0.5,0.5,1,1", minzoom=4) == {t: d for t, d in tiles.items() if at[t] == (4, 8, 7)}
    assert read(minzoom=9) == {}
    wanted = [0, 1, 1, 6, 7, 8, 90, 91, 95, 340, 341, 5000, -3, None]
    got = tile_archive.lookup(spark.createDataFrame([(w, "x") for w in wanted], "tile_id long, data string"), path).collect()
    assert sorted((r.tile_id, bytes(r.data)) for r in got) == sorted((t, tiles[t]) for t in set(wanted) if t in tiles)
    assert tile_archive.lookup(spark.createDataFrame([], "tile_id long"), path).count() == 0


def test_header_is_checked(tmp_path):
    with pytest.raises(ValueError):
        tile_archive.parse_header(b"x" * 127)
    with pytest.raises(ValueError):
        tile_archive.parse_header(b"PMTiles\x02" + b"\0" * 119)


def test_tile_features():
    data = vector_tiles.encode("road", [(7, 2, {"class": "primary", "lanes": 2, "w": 1.5}, [[(0, 0), (5, -3)], [(9, 9), (1, 1)]]), (8, 3, {}, [[(0, 0), (4, 0), (4, 4)]])])
    rows = vector_tiles.decode(data + vector_tiles.encode("other", [(1, 1, {}, [[(2, 2)], [(3, 3)]])]))
    assert [(r[0], r[1], r[2]) for r in rows] == [("road", 7, "LINESTRING"), ("road", 8, "POLYGON"), ("other", 1, "POINT")]
    assert [[(p["x"], p["y"]) for p in path] for path in rows[0][5]] == [[(0, 0), (5, -3)], [(9, 9), (1, 1)]]
    assert rows[0][4]["lanes"]["l"] == 2 and rows[0][4]["w"]["d"] == 1.5 and rows[0][4]["class"]["s"] == "primary"
    assert len(rows[1][5][0]) == 3 and len(rows[2][5]) == 2
    assert vector_tiles.decode(vector_tiles.encode("a", [(1, 1, {}, [])]) + vector_tiles.encode("a", [(2, 1, {}, [])]))[0][1] == 2


def test_extract_round_trip(spark, tmp_path):
    nodes = [(5, 134000000, 525000000, {"highway": "crossing"}), (3, -1, 7, {}), (9, 0, 0, {"a": "b", "c": "d"})]
    ways = [(1, [5, 3, 9], {"highway": "primary"}), (2, [9, 5], {})]
    relations = [(4, [("way", 1, "from"), ("node", 5, "via"), ("way", 2, "to")], {"type": "restriction"})]
    path = str(tmp_path / "x.osm.pbf")
    osm_pbf.write_pbf(path, nodes, ways, relations)
    spark.dataSource.register(osm_pbf.OsmPbf)
    load = lambda t: [tuple(r) for r in spark.read.format("osm_pbf").option("path", path).option("table", t).load().collect()]
    assert load("nodes") == nodes and load("ways") == ways
    assert [(i, [tuple(m) for m in ms], t) for i, ms, t in load("relations")] == relations
    with pytest.raises(ValueError):
        osm_pbf.check_features(b"\x22\x03Foo")
