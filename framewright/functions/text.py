"""Functions of captions, prompts, file names and answers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that tell several persons or one from each other in a caption.
MULTI_PATTERNS = (
    r"\btwo\b",
    r"\bthree\b",
    r"\bfour\b",
    r"\bseveral\b",
    r"\bmultiple\b",
    r"\bmany\b",
    r"\bgroup\b",
    r"\bcrowd\b",
    r"\bpeople\b",
    r"\bindividuals\b",
    r"\bpersons\b",
    r"\ba man and\b",
    r"\ba woman and\b",
    r"\bman and woman\b",
    r"\btwo men\b",
    r"\btwo women\b",
    r"\bcouple\b",
)
SINGLE_PATTERNS = (r"\bsingle\b", r"\balone\b", r"\bsolo\b")


def caption_rule(caption: Column, multi: Sequence[str] = MULTI_PATTERNS, single: Sequence[str] = SINGLE_PATTERNS) -> Column:
    """False for a pattern of several, else true for one of a single, else null: undecided. Several go first."""
    low = F.lower(caption)
    return F.when(low.rlike("|".join(multi)), False).when(low.rlike("|".join(single)), True)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./]*$", 0))


def prompt_of(path: Column) -> Column:
    """The file's stem without the closing number of the sample."""
    return F.regexp_replace(stem(path), r"-\d+$", "")


def prompt_of_clip(path: Column) -> Column:
    """The same for clips of a long video, whose names end in the scene or sample and the clip's number."""
    return F.regexp_replace(F.regexp_replace(stem(path), r"(?:-Scene-\d+|-\d+)_\d+$", ""), r"-\d+$", "")


def part_of(path: Column) -> Column:
    """The first folder of a path called part_*; null where there is none."""
    return F.get(F.filter(F.split(path, "/"), lambda x: x.startswith("part_")), 0)


def sharded_path(id_: Column) -> Column:
    return F.concat_ws("/", F.substring(id_, 1, 2), F.substring(id_, 3, 2), id_)


def json_verdict(text: Column, keys: Sequence[str]) -> Column:
    """struct of booleans from the widest braces in a model's answer; what is missing or can't be read is false."""
    found = F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), ", ".join(f"{k} boolean" for k in keys))
    return F.struct(*[F.coalesce(found[k], F.lit(False)).alias(k) for k in keys])


def decode_one_hot(bits: Column, names: Sequence[str]) -> Column:
    """Names of the positions that hold 1."""
    return F.filter(F.transform(F.array(*map(F.lit, names)), lambda n, i: F.when(F.get(bits, i) == 1, n)), lambda n: n.isNotNull())


def any_set(bits: Column, positions: Sequence[int]) -> Column:
    """Whether any of the positions holds 1; positions past the end hold nothing."""
    return F.exists(F.array(*map(F.lit, positions)), lambda i: F.coalesce(F.get(bits, i) == 1, F.lit(False)))


def and_list(items: Column) -> Column:
    """a; a and b; a, b, and c."""
    n = F.size(items)
    head = F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(1))), ", ")
    last = F.get(items, n - 1)
    return F.when(n == 0, "").when(n == 1, F.get(items, 0)).when(n == 2, F.array_join(items, " and ")).otherwise(F.concat(head, F.lit(", and "), last))


def attribute_caption(gender: Column, adjectives: Column, wearing: Column, nouns: Column, actions: Column) -> Column:
    """A caption built of attribute lists; empty lists leave their phrase out."""
    phrase = lambda word, items: F.when(F.size(items) > 0, F.concat(F.lit(f" {word} "), and_list(items))).otherwise("")
    subject = F.concat(F.lit("a "), F.array_join(F.concat(adjectives, F.array(gender)), " "))
    return F.concat(subject, phrase("wearing", wearing), phrase("with", nouns), phrase("is", actions), F.lit("."))


def numbered_items(text: Column) -> Column:
    """What stands between numbers like '2. '."""
    return F.transform(F.filter(F.split(text, r"\d+\.\s*"), lambda x: F.trim(x) != ""), lambda x: F.trim(x))


def action_label(path: Column) -> Column:
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return F.substring_index(F.element_at(F.split(F.substring_index(name, "-", 1), "person is "), -1), "_", 1)


def object_phrase(prompt: Column, colour: Column) -> Column:
    """Articles and the colour go wherever they stand, inside words too."""
    bare = F.replace(F.replace(F.replace(prompt, F.lit("a "), F.lit("")), F.lit("an "), F.lit("")), colour, F.lit(""))
    return F.trim(bare)


def holds_all_words(text: Column, words: Column) -> Column:
    return F.forall(F.split(words, " "), lambda w: F.contains(text, w))


def says_yes(answer: Column) -> Column:
    return F.contains(F.lower(answer), F.lit("yes"))


def key_of(name: Column) -> Column:
    return F.replace(name, F.lit("_"), F.lit(" "))


def map_key(name: Column, mapping: Mapping[str, str]) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, name), name)


def clock(seconds: Column) -> Column:
    """HH:MM:SS.cc; hundredths may round up to 100."""
    whole = F.floor(seconds).cast("bigint")
    pad = lambda x: F.lpad(x.cast("string"), 2, "0")
    hundredths = F.bround((seconds - whole) * 100).cast("bigint").cast("string")
    return F.concat(pad(F.floor(whole / 3600)), F.lit(":"), pad(F.floor(whole % 3600 / 60)), F.lit(":"), pad(whole % 60), F.lit("."), F.when(F.length(hundredths) < 2, F.lpad(hundredths, 2, "0")).otherwise(hundredths))


def md5_mod(key: Column, n: int) -> Column:
    """The md5 of a key as one 128-bit integer, modulo n: eight hexadecimal digits at a time."""
    digest = F.md5(key.cast("string"))
    rest = F.lit(0).cast("bigint")
    for at in (1, 9, 17, 25):
        rest = F.pmod(rest * (2**32 % n) + F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint"), F.lit(n))
    return rest


def role_of(name: Column) -> Column:
    low = F.lower(stem(name))
    return F.when(low.rlike(r"(^|[_-])gt$"), "gt").when(low.rlike(r"(^|[_-])mask$"), "mask").when(low.rlike(r"(^|[_-])(src|source)$"), "source").otherwise("prediction")


def natural_key(name: Column) -> Column:
    """Sorts a2 before A10 and a1b2 before a1b10: the text in lower case, cut at all runs of digits, each run with its
    number. A run of over 18 digits sorts by its length and digits."""
    pairs = F.regexp_extract_all(F.lower(name), F.lit(r"(\D*)(\d*)"), 0)
    part = lambda x, pattern: F.regexp_extract(x, pattern, 0)
    digits = lambda x: F.regexp_replace(part(x, r"\d+$"), "^0+(?=.)", "")
    return F.transform(pairs, lambda x: F.struct(part(x, r"^\D*").alias("text"), F.length(digits(x)).alias("digits"), digits(x).alias("number")))
