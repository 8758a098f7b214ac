"""Explicit schemas for the observation tables of a field experiment.

Reading with a declared schema avoids an inference pass over the data and
pins integer counts as integers.  Column names are the normalised ones; the
row-number column headed ``...1`` in the raw files is read as ``row_id``.
"""

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


S, I, D, L = T.StringType(), T.IntegerType(), T.DoubleType(), T.LongType()

# The column names of the raw CSV headers (normalised).
EMERGENCE = _struct(
    ("row_id", I), ("date", S), ("stat", I), ("stat2", I), ("before", S), ("loc", S),
    ("trt", S), ("trt2", S), ("days", I), ("area", D), ("totm2d", I), ("total", I),
    ("chir", I), ("cera", I), ("doli", I), ("ephe", I), ("tric", I), ("simu", I),
    ("coleo", I), ("odo", I), ("hem", I),
)

CHIRO_LENGTHS = _struct(
    ("row_id", I), ("mm", D), ("date", S), ("cage", I), ("location", S), ("taxon", S),
    ("trt", S), ("trt2", S),
)

BENTHIC_RAW = _struct(
    ("date", S), ("id", I), ("location", S), ("notes", S), ("trt2", S), ("trt", S),
    ("total", I), ("Chiro_larvae", I), ("Pupae", I), ("Ceratopogonidae", I), ("Corixidae", I),
    ("snails", I), ("Daphnia", I), ("Isopodia", I), ("Ephemeroptera", I), ("Tipulidae", I),
    ("oligochaetes", I), ("Hemiptera", I), ("Copepod", I),
)

SPIDERS = _struct(
    ("date", S), ("stat", I), ("stat2", I), ("loc", S), ("trt", S), ("treatment", S), ("spid", I),
)

FISH_COMMUNITY = _struct(("date", T.DateType()), ("species", S), ("abund", I))

WATER_QUALITY = _struct(
    ("date", S), ("id", I), ("location", S), ("trt", S), ("pH", D), ("cond_uS", I),
    ("temp_C", D), ("depth_cm", D), ("do_mgL", D),
)

DIET = _struct(
    ("id", I), ("date", T.DateType()), ("species", S), ("prey_taxon", S), ("mg_diet_dm", D),
    ("prey_mg_dm", D), ("method", S),
)

BENTHIC_MASS = _struct(("taxon", S), ("mg_dm_per_ind", D), ("experiment", S))

PRIOR_SPEC = _struct(
    ("prior", S), ("class", S), ("coef", S), ("group", S), ("resp", S), ("dpar", S),
    ("nlpar", S), ("bound", S), ("source", S),
)

DRAWS_LONG = _struct(("draw", L), ("term", S), ("coef", D))
