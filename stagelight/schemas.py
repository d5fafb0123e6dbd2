"""Fixed schemas: readers never infer types, empty results keep their columns."""

from pyspark.sql import types as T

ROUNDS = "round_id INT, series STRING"
POSITIONS = "file STRING, fov_id LONG, x DOUBLE, y DOUBLE"
FOCUS_LOG = "file STRING, frame INT, offset DOUBLE, power DOUBLE, stage_z DOUBLE, good BOOLEAN"
FRAME_TABLE = "frame INT, color DOUBLE, channel INT, z DOUBLE, segment STRING"
FRAMES = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("frame", T.IntegerType()), T.StructField("h", T.IntegerType()),
    T.StructField("w", T.IntegerType()), T.StructField("pixels", T.BinaryType()),
])
PROTOCOL_STEPS = "protocol STRING, pos INT, kind STRING, name STRING, duration STRING"
COMMANDS = "kind STRING, name STRING, pos INT"
EVENT_XML = "on STRING, off STRING, channel STRING, power STRING"
PERCENTILES = "round_label STRING, fov_id LONG, frame INT, z DOUBLE, color DOUBLE, min DOUBLE, p25 DOUBLE, p50 DOUBLE, p75 DOUBLE, p95 DOUBLE, max DOUBLE"
COMPLETENESS = "round_id INT, fov_id LONG, path STRING, format STRING, exists BOOLEAN, n_frames_found LONG, n_missing_chunks LONG, n_truncated_chunks LONG, status STRING"
DRIFT = "fov LONG, series STRING, x_drift DOUBLE, y_drift DOUBLE"
STAGE_Z = "round_id INT, fov_id LONG, series STRING, first_stage_z DOUBLE, min_stage_z DOUBLE, max_stage_z DOUBLE, all_same BOOLEAN"

# fixed values: core fields of a sample record
SAMPLE_CORE = ["sample_name", "project", "microscope", "acquisition_type", "lib_name", "data_home", "merlin_home", "folder_name"]
