"""Relations of a set of maps. Features carry tag strings and absolute zoom levels."""

HEADER = """map_id string, file_version bigint, file_size decimal(20,0), creation_date decimal(20,0),
 min_lat int, min_lon int, max_lat int, max_lon int, tile_size int, projection string, has_debug boolean,
 start_lat int, start_lon int, start_zoom int, language string, comment string, created_by string,
 poi_tags array<string>, way_tags array<string>,
 zoom_intervals array<struct<si int, base int, min int, max int, pos bigint, size bigint>>"""
TILE = "map_id string, si int, x int, y int, is_water boolean, offset bigint, length bigint"
TILE_RAW = TILE + ", bytes binary"
FEATURE = """map_id string, si int, x int, y int, zoom int, kind string, ord int, layer int, lat int, lon int,
 tags array<string>, name string, house_number string, elevation int, reference string, label_lat int, label_lon int,
 sub_tile_bitmap int, encoding boolean, explicit_num_blocks boolean, blocks array<array<array<array<int>>>>"""
CHANGE = "si int, x int, y int, flags int, zoom int, patch binary"
VIOLATION = "map_id string, rule string, si int, x int, y int, detail string"

FEATURE_COLUMNS = tuple(c.strip().split(" ")[0] for c in FEATURE.replace("\n", " ").split(", "))
#: What makes two features equal: everything they say, the order of tags aside.
FEATURE_VALUE = tuple(c for c in FEATURE_COLUMNS if c not in ("map_id", "si", "x", "y", "zoom", "kind", "ord"))
TILE_COLUMNS = ("map_id", "si", "x", "y")
