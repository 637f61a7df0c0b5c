"""Fixed dimension tables: values that stand as they are given, in their order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The codes of the method code's fields A to H.
CODES = {
    "A": ["MARKED", "MONOCHROMATIC", "VECTORIAL_MARG", "VECTORIAL_JOINT", "MARKOVIAN"],
    "B": ["SEQUENTIAL", "UNIFORM", "HUFFMAN", "ELIAS"],
    "C": ["TIMESTAMPS", "COUNT", "INTERVALS", "BINARY", "COMBINATORIAL"],
    "D": ["UNIFORM", "MDL", "ADAPTIVE"],
    "E": ["HISTOGRAM", "SPLINES", "WAVELETS", "TRIGONOMETRIC"],
    "F": ["BITS_8", "BITS_16", "BITS_24"],
    "G": ["PIXELS_4", "PIXELS_8", "PIXELS_16", "PIXELS_32"],
    "H": ["CONTINUOUS", "DISCRETE"],
}

# The bank of candidate rules, as name, axis, parameter, value.
RULES = [
    ("pred_paeth", 2, "prediction_mode", "paeth"),
    ("pred_med", 2, "prediction_mode", "med"),
    ("pred_gradient", 2, "prediction_mode", "gradient"),
    ("delta_temporal", 2, "temporal_preprocess", "delta"),
    ("xor_temporal", 2, "temporal_preprocess", "xor"),
    ("rep_r5_runlength", 4, "representation", "r5"),
    ("rep_r6_delta_color", 4, "representation", "r6"),
    ("arithmetic_coding", 4, "entropy_coder", "arithmetic"),
    ("code_methode_huffman", 4, "code_methode_compression", "true"),
    ("per_pixel_rep", 4, "rep_granularity", "pixel"),
    ("palette_threshold_32", 2, "palette_threshold", "32"),
    ("palette_threshold_16", 2, "palette_threshold", "16"),
    ("window_max_64", 2, "max_window", "64"),
    ("window_max_128", 2, "max_window", "128"),
    ("window_ncd_split", 2, "window_criterion", "ncd_gradient"),
    ("block_4x4", 4, "block_size", "4"),
    ("block_16x16", 4, "block_size", "16"),
    ("block_adaptive", 4, "block_size", "adaptive"),
    ("bitpack_uint64", 5, "bool_vector_type", "uint64"),
    ("simd_palette", 5, "palette_lookup", "simd"),
]

# The clips of the default data set by resolution.
CLIPS = {
    "cif": "akiyo bowing bridge-close bridge-far bus coastguard container crew flower foreman hall highway mobile mother-daughter news paris silent stefan tempete waterfall",
    "720p50": "crowd_run ducks_take_off in_to_tree old_town_cross park_joy",
    "720p25": "pedestrian_area",
    "1080p25": "blue_sky pedestrian_area riverbed rush_hour station2 sunflower tractor",
    "1080p50": "crowd_run ducks_take_off in_to_tree old_town_cross park_joy",
    "1080p": "red_kayak",
}
CODECS = ["h264", "h265", "vp9", "av1", "lmd"]

# The axes of the simulation grid, each intensity family with its parameter sets.
SIMULATION = {
    "block_sizes": [8, 16], "r_frames": [32, 64], "m_colors": [8, 16], "basis_families": ["histogram", "polynomial"], "dimensions": [2, 4, 8], "seeds": [42, 123, 456, 789, 1011],
    "intensity_params": {
        "homogeneous": [{"lambda0": 0.01}, {"lambda0": 0.1}],
        "linear": [{"a": 0.001, "b": 0.01}, {"a": -0.001, "b": 0.1}],
        "sinusoidal": [{"lambda0": 0.1, "amplitude": 0.3, "omega": 0.196, "phi": 0.0}, {"lambda0": 0.1, "amplitude": 0.7, "omega": 0.393, "phi": 1.57}],
        "exponential": [{"lambda0": 0.1, "beta": -0.05}, {"lambda0": 0.1, "beta": 0.05}],
    },
}


def codes(spark: SparkSession) -> DataFrame:
    """(field, code, label); field F counts from 1."""
    rows = [(f, i + (f == "F"), name) for f, names in CODES.items() for i, name in enumerate(names)]
    return spark.createDataFrame(rows, "field string, code int, label string")


def rules(spark: SparkSession) -> DataFrame:
    """(rule_id, name, axis, parameter, value) in the bank's order."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(RULES)], "rule_id int, name string, axis int, parameter string, value string")


def clips(spark: SparkSession) -> DataFrame:
    """(data_set, clip, resolution) of the named clips."""
    rows = [("xiph", f"{name}_{size}.y4m", size.split("p")[0] + "p" * ("p" in size)) for size, names in CLIPS.items() for name in names.split()]
    return spark.createDataFrame(rows, "data_set string, clip string, resolution string")
