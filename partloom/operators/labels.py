"""Labels from names and folders, by ordered patterns; the first match wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.functions.text import normal_name

# Patterns (Java and RE2 syntax) and their classes, in order.
PART_RULES = (
    (r"din\s*933", "hex_bolt"), (r"din\s*931", "hex_bolt"), (r"din\s*912", "socket_screw"), (r"din\s*7984", "socket_screw"), (r"din\s*7991", "countersunk_screw"),
    (r"iso\s*4762", "socket_screw"), (r"iso\s*4014", "hex_bolt"), (r"iso\s*4017", "hex_bolt"), (r"iso\s*10642", "countersunk_screw"), (r"iso\s*1458[0-4]", "countersunk_screw"), (r"iso\s*7380", "cap_screw"),
    (r"din\s*934", "hex_nut"), (r"din\s*985", "lock_nut"), (r"iso\s*4032", "hex_nut"),
    (r"din\s*125", "flat_washer"), (r"din\s*127", "spring_washer"), (r"din\s*5406", "lock_washer"), (r"iso\s*7089", "flat_washer"), (r"iso\s*7091", "flat_washer"),
    (r"\bcountersunk\b", "countersunk_screw"), (r"\bcsk\b", "countersunk_screw"), (r"flat[\s_-]*head", "countersunk_screw"), (r"\bcap[\s_-]*screw\b", "cap_screw"), (r"\bsocket[\s_-]*head\b|\ballen\b", "socket_screw"),
    (r"set[\s_-]*screw|grub", "set_screw"), (r"\bbolt\b", "hex_bolt"), (r"\bhex[\s_-]*head\b", "hex_bolt"), (r"\bcarriage\b", "hex_bolt"), (r"\bhex[\s_-]*nut\b|\bhexagon[\s_-]*nut\b", "hex_nut"),
    (r"\block[\s_-]*nut\b|nylock|locknut", "lock_nut"), (r"\bwing[\s_-]*nut\b|wingnut", "wing_nut"), (r"\bspring[\s_-]*washer\b", "spring_washer"), (r"\block[\s_-]*washer\b", "lock_washer"),
    (r"flat[\s_-]*washer|\bplain[\s_-]*washer\b|\bwasher\b", "flat_washer"), (r"\brivet\b", "rivet"), (r"\bcirclip\b|snap[\s_-]*ring|retain", "snap_ring"), (r"\bstud\b", "stud"), (r"\bthreaded[\s_-]*rod\b", "stud"), (r"\banchor\b", "anchor"),
    (r"\bdowel\b|cylindrical[\s_-]*pin|taper[\s_-]*pin|roll[\s_-]*pin|split[\s_-]*pin", "pin"), (r"_pin\b|^pin_", "pin"), (r"\bscrew\b", "cap_screw"), (r"\bnut\b", "hex_nut"),
)
# Names that aren't single parts.
SKIP = (r"\bassem(bly)?\b|_asm\b", r"compound")
# Patterns of harvested names, their subtypes and reasons, in order.
HARVEST_RULES = (
    (r"\b(?:iso|din)\s*[-_ ]?\s*(?:4762|912|7984)\b", "socket_screw", "standard"),
    (r"\b(?:iso|din)\s*[-_ ]?\s*(?:4014|4017|931|933|6921)\b", "hex_bolt", "standard"),
    (r"\b(?:iso|din)\s*[-_ ]?\s*(?:10642|7991|1458[0-4]|7046|7047)\b", "countersunk_screw", "standard"),
    (r"\b(?:iso|din)\s*[-_ ]?\s*(?:7380|7381|7985|7045)\b", "cap_screw", "standard"),
    (r"\b(?:iso|din)\s*[-_ ]?\s*(?:4026|4027|4028|4029|913|914|915|916)\b", "set_screw", "standard"),
    (r"\b(?:iso|din)\s*[-_ ]?\s*(?:4032|4033|4034|4035|4036|934|935|936|985|980|982)\b", "hex_nut", "standard"),
    (r"\b(?:iso|din)\s*[-_ ]?\s*(?:7089|7090|7091|7092|7093|7094|125|126|127|128)\b", "washer", "standard"),
    (r"\b(?:bolt|hex[-_ ]?bolt|carriage[-_ ]?bolt|lag[-_ ]?bolt)\b", "hex_bolt", "keyword"),
    (r"\b(?:socket[-_ ]?head|socket[-_ ]?cap|cap[-_ ]?screw|allen[-_ ]?screw|shcs)\b", "socket_screw", "keyword"),
    (r"\b(?:countersunk|flat[-_ ]?head|csk)\b", "countersunk_screw", "keyword"),
    (r"\b(?:set[-_ ]?screw|grub[-_ ]?screw)\b", "set_screw", "keyword"),
    (r"\b(?:button[-_ ]?head|pan[-_ ]?head|machine[-_ ]?screw|screw)\b", "cap_screw", "keyword"),
    (r"\b(?:hex[-_ ]?nut|lock[-_ ]?nut|locknut|nylock|wing[-_ ]?nut|nut)\b", "hex_nut", "keyword"),
    (r"\b(?:flat[-_ ]?washer|plain[-_ ]?washer|spring[-_ ]?washer|lock[-_ ]?washer|washer)\b", "washer", "keyword"),
    (r"\b(?:rivet|blind[-_ ]?rivet|solid[-_ ]?rivet)\b", "rivet", "keyword"),
    (r"\b(?:dowel[-_ ]?pin|taper[-_ ]?pin|roll[-_ ]?pin|split[-_ ]?pin|cotter[-_ ]?pin)\b", "pin", "keyword"),
    (r"\b(?:stud|threaded[-_ ]?rod)\b", "stud", "keyword"),
    (r"\b(?:retaining[-_ ]?ring|snap[-_ ]?ring|circlip|e[-_ ]?ring)\b", "snap_ring", "keyword"),
    (r"\banchor\b", "anchor", "keyword"),
)
# A metric size, names of other things and their reasons, assemblies, and words that only look like fasteners.
METRIC_SIZE = r"\bm\s*\d+(?:[.,_]\d+)?\s*(?:x|X|by)\s*\d+(?:[.,_]\d+)?\b"
NEGATIVE_RULES = (
    (r"\b(?:bracket|mounting[-_ ]?plate|plate|panel|cover|lid)\b", "structural"),
    (r"\b(?:housing|case|body|base|frame|chassis|support|stand)\b", "structural"),
    (r"\b(?:gear|wheel|pulley|sprocket|shaft|axle|lever|arm|linkage)\b", "mechanism"),
    (r"\b(?:pipe|tube|manifold|flange|fitting|valve|nozzle)\b", "fluid"),
    (r"\b(?:bearing|bushing|spacer|standoff|shim)\b", "hardware_nonfastener"),
    (r"\b(?:pcb|pcba|circuit[-_ ]?board)\b", "electronics"),
)
ASSEMBLY_HINT = r"\b(?:assembly|assemblage|assy|asm|subassembly|sub[-_ ]?asm)\b"
OVERRIDE = r"\b(?:screwdriver|nutcracker|pinion|piniongear|washerfluid)\b"
# Keywords of fasteners, a metric code, words that rule them out, and names that settle a class.
KEYWORDS = (
    "bolt", "screw", "nut", "washer", "stud", "rivet", "fastener", "threaded", "dowel", "anchor", "clip", "circlip",
    "din125", "din126", "din127", "din128", "din912", "din913", "din914", "din915", "din916", "din931", "din933", "din934", "din935", "din936", "din7984", "din7985", "din7991", "din6912", "din6921", "din985", "din980", "din982",
    "iso4014", "iso4017", "iso4026", "iso4027", "iso4028", "iso4029", "iso4032", "iso4033", "iso4034", "iso4035", "iso4036", "iso4762", "iso7089", "iso7090", "iso7091", "iso7092", "iso7093", "iso7094", "iso7380", "iso7381",
    "iso10642", "iso14580", "iso14581", "iso14583", "iso14584", "iso7045", "iso7046", "iso7047",
    "hex_head", "hex head", "cap_screw", "cap screw", "lag_bolt", "socket_head", "pan_head", "flat_head", "button_head", "countersunk",
)
METRIC_CODE = r"m\d+(?:[._]\d+)?x\d+"
NOT_FASTENERS = ("housing", "bracket_asm", "panel_asm", "assembly", "_asm", "_sub", "pcb_", "pcba_")
NAMED_TRUTH = (
    ("^DIN912[_-]", "screws", "iso_din"), ("^DIN125", "washers", "iso_din"), ("^ISO14581[_-]", "screws", "iso_din"), ("^ISO14583[_-]", "screws", "iso_din"),
    ("^M1_NUT", "nuts", "iso_din"), ("^IOBC_DB_SPACER", "spacers", "journal_verified"), ("^761_M05", "washers", "journal_verified"),
)


def _any_case(name: Column, pattern: str) -> Column:
    return name.rlike("(?i)" + pattern)


def name_class(name: Column) -> Column:
    out = F.when(_any_case(name, SKIP[0]) | _any_case(name, SKIP[1]), "_skip")
    for pattern, cls in PART_RULES:
        out = out.when(_any_case(name, pattern), cls)
    return out.otherwise("_unknown")


def harvest_label(name: Column) -> Column:
    """Struct (label, reason, subtype) of a file or part name."""
    n = normal_name(name)
    pick = lambda label, reason, sub=None: F.struct(F.lit(label).alias("label"), F.lit(reason).alias("reason"), F.lit(sub).cast("string").alias("subtype"))
    out = F.when((n == "") | n.isNull() | F.startswith(F.lower(n), F.lit("unnamed solid")), pick("unknown", "unnamed")).when(_any_case(n, OVERRIDE), pick("unknown", "fastener_override"))
    for pattern, sub, reason in HARVEST_RULES:
        out = out.when(_any_case(n, pattern), pick("fastener", reason, sub))
    out = out.when(n.rlike(METRIC_SIZE), pick("fastener", "metric_size", "metric_fastener")).when(_any_case(n, ASSEMBLY_HINT), pick("assembly", "assembly_hint"))
    for pattern, reason in NEGATIVE_RULES:
        out = out.when(_any_case(n, pattern), pick("non_fastener", reason))
    return out.otherwise(pick("unknown", "no_rule"))


def keyword_label(name: Column) -> Column:
    low = F.lower(name)
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    unnamed = name.isNull() | (name == "") | F.startswith(name, F.lit("unnamed_solid_")) | F.startswith(low, F.lit("compound"))
    return F.when(unnamed, "unknown").when((has(KEYWORDS) | low.rlike(METRIC_CODE)) & ~has(NOT_FASTENERS), "fastener").otherwise("non-fastener")


def named_truth(name: Column) -> Column:
    """Struct (cls, source) for names that settle their class; null for others. Instance suffixes go first."""
    stem = F.regexp_replace(name, "#\\d+$", "")
    out = None
    for pattern, cls, source in NAMED_TRUTH:
        one = F.struct(F.lit(cls).alias("cls"), F.lit(source).alias("source"))
        out = F.when(stem.rlike(pattern), one) if out is None else out.when(stem.rlike(pattern), one)
    return out


def names_standard(name: Column) -> Column:
    return name.rlike("(?i)(^|[^a-z])(iso|din)[\\s_-]*\\d+")


def status(is_fastener: Column, predicted: Column) -> Column:
    """TP, FP, FN or TN; UNK where the truth is unknown (null)."""
    return F.when(is_fastener.isNull(), "UNK").when(is_fastener & predicted, "TP").when(predicted, "FP").when(is_fastener, "FN").otherwise("TN")


# Colours of the statuses.
STATUS_COLOURS = {"TP": "#2ca02c", "FP": "#d62728", "FN": "#ff7f0e", "TN": "#7f7f7f", "UNK": "#1f77b4"}


def status_summary(df: DataFrame, status_column: str = "status") -> DataFrame:
    n = lambda s: F.sum((F.col(status_column) == s).cast("long"))
    out = df.agg(*[n(s).alias(s.lower()) for s in STATUS_COLOURS])
    div = lambda a, b: F.coalesce(F.when(b > 0, a / b), F.lit(0.0))
    out = out.withColumn("precision", div(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", div(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def folder_score(df: DataFrame, accepted: DataFrame) -> DataFrame:
    """df (file, folder, pred) against accepted (folder, types): correct, wrong or missed (unclassified)."""
    j = df.join(accepted, "folder", "left")
    verdict = F.when(F.col("pred").isNull() | (F.col("pred") == "unclassified"), "missed").when(F.coalesce(F.array_contains("types", F.col("pred")), F.lit(False)), "correct").otherwise("wrong")
    return j.withColumn("verdict", verdict).drop("types")


def best_per_file(df: DataFrame) -> DataFrame:
    """The label of the highest confidence per file, the first part on ties."""
    return df.groupBy("file").agg(F.max_by(F.struct("pred", "confidence"), F.struct("confidence", -F.col("ord"))).alias("b")).select("file", "b.*")


# The 13 classes that rule types fold into; others are non_fastener.
SUBTYPES = {
    "hex_bolt": "screws", "socket_head_cap_screw": "screws", "button_head_screw": "screws", "countersunk_socket_screw": "screws", "wood_screw": "screws", "set_screw": "screws",
    "hex_nut": "nuts", "thin_hex_nut": "nuts", "square_nut": "nuts", "flat_washer": "washers", "chamfered_washer": "washers",
    "threaded_stud": "threaded-rods", "threaded_insert": "threaded-inserts", "dowel_pin": "pins", "rivet": "rivets",
}


def subtype(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in SUBTYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, kind), F.lit("non_fastener"))


def tally(labels: DataFrame, buckets: dict[str, str], kind: Column) -> DataFrame:
    """Counts and mean confidence per bucket, buckets without parts included."""
    spark = labels.sparkSession
    names = spark.createDataFrame([(b,) for b in dict.fromkeys(buckets.values())], "bucket string")
    table = F.create_map(*[F.lit(x) for kv in buckets.items() for x in kv])
    counted = labels.withColumn("bucket", F.try_element_at(table, kind)).groupBy("bucket").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"))
    return names.join(counted, "bucket", "left").na.fill(0, ["n"])
