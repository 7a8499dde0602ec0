"""Tag and caption algebra as Column functions.

Texts are comma-separated tag lists; order and duplicates count.  Every function is a native expression.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagweave.functions import vocab

STRINGS = "array<string>"


def literals(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(STRINGS) if values else F.array().cast(STRINGS)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def sql_quote(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def parse(text: Column) -> Column:
    """Tags of a text: one pass over ", " and over double blanks, then cut at commas; nothing is trimmed, empties stay."""
    return F.split(F.replace(F.replace(text, F.lit(", "), F.lit(",")), F.lit("  "), F.lit(" ")), ",", -1)


def join(tags: Column) -> Column:
    """Joined by ", ", which is left out after every tag that equals the last one."""
    return let(tags, lambda ts: F.array_join(F.transform(ts, lambda t: F.when(t == F.element_at(ts, -1), t).otherwise(F.concat(t, F.lit(", ")))), ""))


def add_emphasize_remove(tags: Column, add: Sequence[str] = (), emphasize: Sequence[str] = (), remove: Sequence[str] = ()) -> Column:
    """Added tags first, then emphasised ones that occur in any case, then the rest; removed ones go, repeats go."""

    def built(ts: Column) -> Column:
        front = F.filter(literals(emphasize), lambda e: F.exists(ts, lambda t: F.lower(t) == F.lower(e)))
        every = F.concat(literals(add), front, ts)
        return F.array_distinct(F.filter(every, lambda t: ~F.array_contains(literals(remove), t)))

    return let(tags, built)


def replace_tags(tags: Column, old: Sequence[str], new: Sequence[str]) -> Column:
    """Exact replacement, the first pair of a key counts; repeats go."""
    if len(old) != len(new):
        raise ValueError("as many new tags as old ones are needed")
    if not old:
        return F.array_distinct(tags)
    pairs: dict[str, str] = {}
    for a, b in zip(old, new, strict=True):
        pairs.setdefault(a, b)
    table = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    return F.array_distinct(F.transform(tags, lambda t: F.coalesce(F.try_element_at(table, t), t)))


def _java_word(word: str) -> str:
    return r"(?iuU)\b\Q" + word.replace(r"\E", r"\E\\E\Q") + r"\E\b"


def find_replace(text: Column, old: Sequence[str], new: Sequence[str]) -> Column:
    """In every comma part, each word or phrase in turn, in any case, unless the part holds its substitute already."""
    if len(old) != len(new):
        raise ValueError("as many substitutes as words are needed")

    def one(part: Column) -> Column:
        for a, b in zip(old, new, strict=True):
            quoted = b.replace("\\", "\\\\").replace("$", "\\$")
            part = F.when(F.contains(part, F.lit(b)), part).otherwise(F.regexp_replace(part, _java_word(a), quoted))
        return part

    return F.array_join(F.transform(parse(text), one), ", ")


def shuffled(tags: Column, key: Column, seed: str) -> Column:
    """Repeatable random order: by SHA-256 of seed, key and place; joined as ``join`` does."""
    keyed = F.transform(tags, lambda t, i: F.struct(F.sha2(F.concat(F.lit(seed + ":"), key.cast("string"), F.lit(":"), i.cast("string")), 256).alias("h"), t.alias("t")))
    return F.transform(F.array_sort(keyed), lambda x: x["t"])


_PLAIN = "'^[A-Za-z0-9]+( [A-Za-z0-9]+)*$'"


def word_in_sql(part: str, whole: str) -> str:
    """SQL: ``part`` stands in ``whole`` between word boundaries, in any case.

    A plain test comes first; words of ASCII letters between single blanks need no pattern, which would be compiled anew for each pair."""
    blanks = f"contains(concat(' ', lower({whole}), ' '), concat(' ', lower({part}), ' '))"
    pattern = rf"regexp_like({whole}, concat('(?iuU)\\b\\Q', replace({part}, '\\E', '\\E\\\\E\\Q'), '\\E\\b'))"
    return f"(contains(lower({whole}), lower({part})) AND IF(rlike({part}, {_PLAIN}) AND rlike({whole}, {_PLAIN}), {blanks}, {pattern}))"


def redundant_sql(a: str, b: str) -> str:
    return f"({word_in_sql(a, b)} OR {word_in_sql(b, a)})"


def category_sql(tag: str) -> str:
    """SQL: array of the category tests of a tag; a category's words are one pattern, compiled once."""
    tests = []
    for _, words, ruled_out, _ in vocab.CATEGORIES:
        if words is None:
            tests.append(f"contains({tag}, 'eyewear')")
            continue
        pattern = "|".join(words)  # letters, blanks and hyphens only
        tests.append("(" + " AND ".join([f"rlike(lt, {sql_quote(pattern)})", *[f"NOT contains({tag}, {sql_quote(x)})" for x in ruled_out]]) + ")")
    return _let(f"lower({tag})", "lt", f"array({', '.join(tests)})")


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _put(s: str, f: str, t: str, h: str) -> str:
    """SQL: add a tag to the slots: nothing if it is there, else the slot freed last, else a new one."""
    return (
        f"CASE WHEN coalesce(array_contains({s}, {t}), false) THEN named_struct('s', {s}, 'f', {f}, 'h', {h}) "
        f"WHEN size({f}) > 0 THEN named_struct('s', transform({s}, (p, i) -> IF(i = {f}[0], {t}, p)), 'f', slice({f}, 2, size({f})), 'h', {h}) "
        f"ELSE named_struct('s', concat({s}, array({t})), 'f', {f}, 'h', {h}) END"
    )


def fold_sql(rows: str, redundant: str = "array_contains(x.r, p)") -> str:
    """SQL for the kept tags, in slot order, of an array of described tags: t, c (tests of its categories), r (tags of the text it is redundant with).

    ``redundant`` is the test of a tag x against a kept one p."""
    tags = f"transform({rows}, x -> x.t)"
    n = len(vocab.CATEGORIES)
    several = [f"NOT exists({tags}, t -> lower(t) IN ({', '.join(map(sql_quote, x))}))" if x else "true" for *_, x in vocab.CATEGORIES]
    meets = f"transform(a.s, p -> CASE WHEN p IS NULL THEN 0 WHEN {redundant} THEN IF(length(x.t) < length(p), 1, 2) ELSE 0 END)"
    facts = (
        "named_struct('red', array_contains(IF(j = 0, r, slice(r, 1, cast(j AS int) - 1)), 1), "
        "'s', IF(j > 0, transform(a.s, (p, i) -> IF(i = j - 1, cast(null AS string), p)), a.s), "
        "'f', IF(j > 0, concat(array(cast(j - 1 AS int)), a.f), a.f), "
        "'k', cast(array_position(zip_with(x.c, a.h, (b, d) -> b AND NOT d), true) AS int))"
    )
    held = "transform(a.h, (b, i) -> b OR (i = e.k - 1 AND st[i]))"
    cleared = f"named_struct('s', transform(e.s, p -> IF(p IS NOT NULL AND {redundant}, cast(null AS string), p)), 'h', a.h)"
    freed = "filter(transform(e.s, (p, i) -> IF(p IS NOT NULL AND g.s[i] IS NULL, i, -1)), i -> i >= 0)"
    general = _let(cleared, "g", _let(f"concat(reverse({freed}), e.f)", "q", _put("g.s", "q", "x.t", "a.h")))
    step = f"CASE WHEN e.k > 0 THEN {_put('e.s', 'e.f', 'x.t', held)} WHEN e.red OR array_contains(x.c, true) THEN named_struct('s', e.s, 'f', e.f, 'h', a.h) ELSE {general} END"
    step = _let(meets, "r", _let("array_position(r, 2)", "j", _let(facts, "e", step)))
    start = f"named_struct('s', cast(array() AS array<string>), 'f', cast(array() AS array<int>), 'h', array_repeat(false, {n}))"
    fold = f"aggregate({rows}, {start}, (a, x) -> {step}, a -> a.s)"
    stop = ", ".join(map(sql_quote, vocab.STOP_TAGS))
    return _let(f"array({', '.join(several)})", "st", f"filter({fold}, p -> p IS NOT NULL AND lower(p) NOT IN ({stop}))")


def without_redundant_sql(tags: str) -> str:
    """SQL for the kept tags, in slot order, of an array of tags (see ``without_redundant``)."""
    rows = f"transform({tags}, t -> named_struct('t', t, 'c', {category_sql('t')}))"
    return _let(rows, "rows", fold_sql("rows", redundant_sql("x.t", "p")))


def without_redundant(tags: str) -> Column:
    """Tags of the named array column without redundant ones and with one value for each category.

    A tag is redundant with another when either holds the other between word boundaries.  Kept tags live in
    slots; a removed tag's slot is taken by the next that comes, which fixes the order of the result.
    """
    return F.expr(without_redundant_sql(tags))


def redundancy_removed(name: str) -> Column:
    """The tag text in the named column after redundancy removal, as text."""
    tags = f"split(replace(replace({name}, ', ', ','), '  ', ' '), ',', -1)"
    return join(F.expr(f"transform(array({tags}), ts -> {without_redundant_sql('ts')})[0]"))


def is_edge_case(tag: Column) -> Column:
    """Whether consolidation leaves a tag alone."""
    words = "|".join(rf"\Q{w}\E" for w in vocab.EDGE_WORDS)
    equal = tag.isin(*vocab.EDGE_TAGS, *vocab.EYE_COLORS)
    parts = F.contains(tag, F.lit(vocab.EDGE_PARTS[0])) | F.contains(tag, F.lit(vocab.EDGE_PARTS[1]))
    return F.rlike(tag, F.lit(rf"(?iuU)\b({words})\b")) | equal | parts


def hash_key(word: Column) -> Column:
    """Signed little-endian number of the first four bytes of SHA-256."""
    h = F.sha2(word, 256)
    turned = F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2))
    n = F.conv(turned, 16, 10).cast("long")
    return F.when(n >= 1 << 31, n - (1 << 32)).otherwise(n)


def hash_sorted(words: Column) -> Column:
    """Distinct words in the order of their hash keys; a list of one or none as it is."""
    keyed = F.transform(F.array_distinct(words), lambda w, i: F.struct(hash_key(w).alias("h"), i.alias("i"), w.alias("w")))
    return F.when(F.size(words) <= 1, words).otherwise(F.transform(F.array_sort(keyed), lambda x: x["w"]))


def _groups(tags: Column) -> Column:
    """(passed array, multi array<array<string>>): tags that pass, and the words of the others."""
    grouped = lambda t: F.contains(t, F.lit(" ")) & ~is_edge_case(t)
    passed = F.filter(tags, lambda t: ~grouped(t))
    multi = F.transform(F.filter(tags, grouped), lambda t: F.split(t, " ", -1))
    return F.struct(passed.alias("passed"), multi.alias("multi"))


def similar(tags: Column) -> Column:
    """Map of last word to the other words of the tags that end in it, in first-seen order."""
    last = lambda w: F.element_at(w, -1)
    others = lambda g, name: F.flatten(F.transform(F.filter(g, lambda w: last(w) == name), lambda w: F.filter(w, lambda x: x != name)))
    built = lambda g: let(F.array_distinct(F.transform(g, last)), lambda names: F.map_from_arrays(names, F.transform(names, lambda n: others(g, n))))
    return let(_groups(tags)["multi"], built)


def consolidated(text: Column) -> Column:
    """Tags that end in the same word become one: the other words in hash order, then that word."""

    def built(x: Column) -> Column:
        def group(last: Column) -> Column:
            own = F.flatten(F.transform(F.filter(x["multi"], lambda w: F.element_at(w, -1) == last), lambda w: F.filter(w, lambda y: y != last)))
            return F.array_join(F.concat(F.array_distinct(hash_sorted(own)), F.array(last)), " ")

        lasts = F.array_distinct(F.transform(x["multi"], lambda w: F.element_at(w, -1)))
        every = F.concat(x["passed"], F.transform(lasts, group))
        return F.when(F.size(x["multi"]) == 0, F.lit(None)).otherwise(F.array_join(F.array_distinct(every), ", "))

    return F.coalesce(F.transform(F.array(_groups(parse(text))), built)[0], text)


def outliers(text: Column, words: int = 4) -> Column:
    """Tags of a text, cut at ", ", of at least so many blank-separated words."""
    return F.filter(F.split(text, ", ", -1), lambda t: F.size(F.split(t, " ", -1)) >= words)


def counted(text: Column) -> Column:
    """Tags as the frequency table takes them: line breaks are deleted first."""
    return parse(F.regexp_replace(text, r"\r\n?|\n", ""))


def draw_number(key: Column, i: Column, seed: str) -> Column:
    """The i-th number drawn for a key: 32 bits of SHA-256, as a long."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(seed + ":"), key.cast("string"), F.lit(":"), i.cast("string")), 256), 1, 8), 16, 10).cast("long")


def sampled_prompt(tags: Column, key: Column, n: int, seed: str, prefix: str = "", suffix: str = "") -> Column:
    """``n`` draws with replacement, uniform over the distinct tags, between prefix and suffix, with separators cleaned."""
    drawn = let(F.array_distinct(tags), lambda ts: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.element_at(ts, (draw_number(key, i, seed) % F.size(ts) + 1).cast("int"))))
    return cleaned_prompt(F.concat_ws(", ", *([F.lit(prefix)] if prefix else []), F.array_join(drawn, ", "), *([F.lit(suffix)] if suffix else [])))


def cleaned_prompt(text: Column) -> Column:
    for old, new in ((", , ", ", "), (", ,", ", "), ("  ", " ")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def prompt_metadata(text: Column) -> Column:
    """(positive, negative, parameters) of a generation record; one trailing comma goes from each, then blanks.

    Without "Negative prompt: " the negative part is empty; without "Steps: " the parameters are null."""
    tidy = lambda s: F.regexp_replace(F.regexp_replace(s, r", ?\z", ""), r"\s+\z", "")
    has = F.contains(text, F.lit("Negative prompt: "))
    parts = F.split(text, "Negative prompt: ", -1)
    body = F.split(F.when(has, F.try_element_at(parts, F.lit(2))).otherwise(text), "Steps: ", -1)
    positive = F.when(has, F.element_at(parts, 1)).otherwise(F.element_at(body, 1))
    negative = F.when(has, F.element_at(body, 1)).otherwise(F.lit(""))
    return F.struct(tidy(positive).alias("positive"), tidy(negative).alias("negative"), tidy(F.concat(F.lit("Steps: "), F.try_element_at(body, F.lit(2)))).alias("parameters"))


def seed_of(parameters: Column) -> Column:
    """Value of the last part that begins with "Seed" in any case; null if there is none."""
    parts = F.filter(F.transform(F.split(parameters, ",", -1), lambda p: F.trim(p)), lambda p: F.startswith(F.lower(p), F.lit("seed")))
    return F.trim(F.substring_index(F.try_element_at(parts, F.lit(-1)), ":", -1))


def stripped_end(caption: Column) -> Column:
    """A trimmed caption without the end mark of the decoder."""
    return F.rtrim(F.regexp_replace(F.trim(caption), "</s>$", ""))


def appended(existing: Column, generated: Column) -> Column:
    return F.concat(F.replace(existing, F.lit("_"), F.lit(" ")), F.lit(", "), generated)


def first_prompt(tags: Column, user: Column, base: Column) -> Column:
    """The tags' text, else the user's prompt; an empty one falls through to the base prompt."""
    found = F.coalesce(tags, user)
    return F.when(found.isNull() | (found == ""), base).otherwise(found)
