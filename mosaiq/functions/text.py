"""Column builders for answer parsing and text, with Python's semantics where they differ from Spark's. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "ABCDEFGHIJKLM"


def first_group(s: Column, pattern: Column) -> Column:
    """regexp_extract with a pattern that may differ by row."""
    return F.call_function("regexp_extract", s, pattern, F.lit(1))


def pytrim(s: Column) -> Column:
    """Python's str.strip for ASCII white space."""
    return F.regexp_replace(s, "^\\s+|\\s+$", "")


def pycap(s: Column) -> Column:
    """Python's str.capitalize."""
    return F.concat(F.upper(F.left(s, F.lit(1))), F.lower(F.substr(s, F.lit(2))))


def pystr(c: Column, boolean: bool = False) -> Column:
    """Python's str() of a grouping key: 'None' for null, 'True' and 'False' for booleans."""
    if boolean:
        return F.when(c.isNull(), "None").when(c, "True").otherwise("False")
    return F.coalesce(c.cast("string"), F.lit("None"))


def extract_think(t: Column) -> Column:
    """X-01: the first think body, else what stands before a lone closing tag, else ''."""
    body = F.regexp_extract(t, "(?s)<think>\\s*(.*?)\\s*</think>", 1)
    return F.when(t.rlike("(?s)<think>.*?</think>"), pytrim(body)).when(F.contains(t, F.lit("</think>")), pytrim(F.substring_index(t, "</think>", 1))).otherwise("")


def extract_answer(t: Column) -> Column:
    """X-02: the first answer body, stripped, else ''."""
    return pytrim(F.regexp_extract(t, "(?s)<answer>(.*?)</answer>", 1))


# The phrases that announce a conclusion, and other answer patterns.
CONCLUDE_LETTER = "(?i)(?:final\\s+answer|best\\s+answer|correct\\s+answer|the\\s+answer|answer)\\s*(?:is|:|=|would\\s+be)?\\s*\\(?(["
CONCLUDE_YESNO = "(?i)(?:final\\s+answer|the\\s+answer|answer)\\s*(?:is|:|=)?\\s*\\(?(yes|no)\\b"
OPTION_MARK = "(?:^|[,;]\\s*)([A-H])\\.\\s"


def parse_choice(t: Column, is_yesno: Column, letters: Column) -> Column:
    """X-03: the chosen letter or Yes/No. In a non-empty answer tag the first bare one, else the raw body; without it the last explicit conclusion; else ''."""
    body = extract_answer(t)
    token = F.when(is_yesno, F.lit("yes|no")).otherwise(F.concat(F.lit("["), letters, F.lit("]")))
    bare = first_group(body, F.concat(F.lit("(?i)\\b("), token, F.lit(")\\b")))
    said = F.regexp_extract_all(t, F.when(is_yesno, F.lit(CONCLUDE_YESNO)).otherwise(F.concat(F.lit(CONCLUDE_LETTER), letters, F.lit("])\\b"))), F.lit(1))
    shape = lambda x: F.when(is_yesno, pycap(x)).otherwise(F.upper(x))
    return F.when((body != "") & (bare != ""), shape(bare)).when(body != "", body).when(F.size(said) > 0, shape(F.element_at(said, -1))).otherwise("")


def gt_choice(answer: Column, is_yesno: Column, letters: Column) -> Column:
    """X-04: the gold choice: yes/no capitalised; else the first letter anywhere, without word boundaries; else the upper-cased answer."""
    a = pytrim(answer)
    hit = first_group(a, F.concat(F.lit("(?i)(["), letters, F.lit("])")))
    return F.when(is_yesno, pycap(a)).when(hit != "", F.upper(hit)).otherwise(F.upper(a))


def is_correct(pred: Column, gold: Column) -> Column:
    """X-05."""
    return F.upper(pytrim(pred)) == F.upper(pytrim(gold))


def fixed(x: Column, places: int = 1) -> Column:
    """A number with 0 to 2 decimals as printf writes it: by its exact binary value, with ties to even. format_string rounds the shortest decimal text instead."""
    one, ten = 1 << 52, 10**places
    size = F.abs(x.cast("double"))
    whole = F.floor(size).cast("bigint")
    scaled = (size - whole) * float(one)  # the fraction in units of 2^-52; small numbers have more bits than that
    more = (scaled - F.floor(scaled)) * ten
    n = F.floor(scaled).cast("bigint") * ten + F.floor(more).cast("bigint")
    rest = F.pmod(n, F.lit(one))
    part = ((n - rest) / F.lit(float(one))).cast("bigint")
    last = whole * ten + part
    up = (rest > one // 2) | ((rest == one // 2) & ((more > F.floor(more)) | (last % 2 == 1)))
    last = last + F.when(up, 1).otherwise(0)
    sign = F.when((x < 0), "-").otherwise("")
    return F.concat(sign, F.format_string("%d", last) if not places else F.format_string(f"%d.%0{places}d", F.floor(last / ten).cast("bigint"), last % ten))


def normpath(path: Column) -> Column:
    """P-08: a path without empty, '.' and resolvable '..' parts; '' is '.'. A leading slash stays, and '..' beyond the root goes."""
    rooted = F.startswith(path, F.lit("/"))

    def step(acc, x):
        up = (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1) != "..")
        pop = F.slice(acc, 1, F.size(acc) - 1)
        return F.when(x != "..", F.concat(acc, F.array(x))).when(up, pop).when(rooted, acc).otherwise(F.concat(acc, F.array(x)))

    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    out = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(rooted, F.concat(F.lit("/"), out)).when(out == "", F.lit(".")).otherwise(out)


def current_summary(line: Column, version: str) -> Column:
    """F-11: a JSON line with a summary, without an error, and of the current version, as which a line without the key counts, but not one with a null."""
    row = F.try_parse_json(line)
    text = lambda k: F.coalesce(F.try_variant_get(row, f"$.{k}", "string"), F.lit(""))
    keyed = F.coalesce(F.array_contains(F.json_object_keys(line), "prompt_ver"), F.lit(False))
    return (text("summary") != "") & (text("error") == "") & (~keyed | (text("prompt_ver") == version))


def normalized(question: Column, answer: Column) -> Column:
    """P-05: (question, answer, flags) of a raw question text and an answer as JSON.

    A question that is itself a JSON text broken by inner quotes is recovered by its keys; an answer that is an object gives its correct
    option, else its answer. Flags name what was found, in that order.
    """
    encoded = F.startswith(F.ltrim(question), F.lit("{"))
    inner = F.regexp_extract(question, r'(?s)"question":\s*"(.*?)",\s*\n\s*"options"', 1)
    option = F.regexp_count(question, F.lit(r'(?s)"[ABCD]":\s*"(.*?)"(?=,\n|\n\s*\})')) > 0
    told = F.regexp_extract(question, r'"(?:correct_option|answer)":\s*"([ABCD])"', 1)
    recovered = encoded & (inner != "") & option & (told != "")
    value = F.try_parse_json(answer)
    held = F.startswith(F.ltrim(answer), F.lit("{"))
    plain = F.when(held, F.lit(None)).otherwise(F.try_variant_get(value, "$", "string"))
    filled = ~held & F.coalesce(plain != "", F.lit(False))
    from_object = F.coalesce(F.nullif(F.try_variant_get(value, "$.correct_option", "string"), F.lit("")), F.try_variant_get(value, "$.answer", "string"))
    found = F.when(held, from_object).when(filled, plain).when(recovered, told)
    missing = F.coalesce(found, F.lit("")) == ""
    flags = [
        F.when(recovered, F.lit("double_encoded_question")).when(encoded, F.lit("unparseable_question_json")),
        F.when(held, F.lit("dict_answer")),
        F.when(missing, F.lit("missing_answer")),
    ]
    return F.struct(F.when(recovered, inner).otherwise(question).alias("question"), F.when(~missing, found).alias("answer"), F.array_compact(F.array(*flags)).alias("flags"))


def extract_letter(t: Column, candidates: Column) -> Column:
    """X-06: 'answer: x' first; else the first lone letter that starts a candidate; else the first lone letter; else the first character."""
    low = F.lower(t)
    explicit = F.regexp_extract(low, "answer\\s*[:=]\\s*\\(?([a-z])\\)?", 1)
    alone = F.regexp_extract_all(low, F.lit("(?<![\\p{L}\\p{N}_])([a-z])(?![\\p{L}\\p{N}_])"), F.lit(1))  # words of any script, as \\b would have it
    valid = F.transform(candidates, lambda c: F.lower(F.left(pytrim(c), F.lit(1))))
    good = F.filter(alone, lambda x: F.array_contains(valid, x))
    return F.when(explicit != "", explicit).when(F.size(good) > 0, F.get(good, F.lit(0))).when(F.size(alone) > 0, F.get(alone, F.lit(0))).otherwise(F.left(pytrim(low), F.lit(1)))


def extract_number(t: Column) -> Column:
    """X-07: 'answer: n' first, else the first number, else the stripped text."""
    low = F.lower(t)
    explicit = F.regexp_extract(low, "answer\\s*[:=]\\s*(-?[0-9]+\\.?[0-9]*)", 1)
    first = F.regexp_extract(t, "-?[0-9]+\\.?[0-9]*", 0)
    return F.when(explicit != "", explicit).when(first != "", first).otherwise(pytrim(t))


def mc_reply(model: Column, reply: Column) -> Column:
    """X-08: the first character for models that answer with a few tokens, else the whole reply; stripped and lower-cased."""
    low = F.lower(pytrim(reply))
    return F.when(model.isin("gpt-5.2", "gpt-5", "o3"), F.left(low, F.lit(1))).otherwise(low)


def judge_score(t: Column) -> Column:
    """X-09: the score tag clamped to 0..1, else the last lone number from 0 to 1, else null."""
    tag = F.regexp_extract(t, "<score>\\s*([0-9]*\\.?[0-9]+)\\s*</score>", 1)
    alone = F.regexp_extract_all(t, F.lit("\\b(0\\.[0-9]+|1\\.0|0\\.0|1|0)\\b"), F.lit(1))
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), tag.try_cast("double")))
    return F.when(tag != "", value).when(F.size(alone) > 0, F.element_at(alone, -1).try_cast("double"))


def verdict(t: Column) -> Column:
    """X-10: the verdict tag, else the first of YES, PARTIAL and NO that occurs, in that order, else NO."""
    tag = F.upper(F.regexp_extract(t, "(?i)<verdict>\\s*(yes|no|partial)\\s*</verdict>", 1))
    up = F.upper(t)
    return F.when(tag != "", tag).when(up.rlike("\\bYES\\b"), "YES").when(up.rlike("\\bPARTIAL\\b"), "PARTIAL").otherwise("NO")


def claims(t: Column) -> Column:
    """X-11: the lines of a claim list without numbers and bullets; blank ones dropped."""
    bare = F.transform(F.split(pytrim(t), "\n"), lambda x: pytrim(F.regexp_replace(x, "^\\s*(?:[0-9]+[.)]|[-*])\\s*", "")))
    return F.filter(bare, lambda x: x != "")


def strip_think(t: Column) -> Column:
    """X-12: think spans replaced by a space, an unclosed one to the end."""
    return F.regexp_replace(F.regexp_replace(t, "(?s)<think>.*?</think>", " "), "(?s)<think>.*\\z", " ")


def numbers(t: Column, k: Column) -> Column:
    """X-13: the numbers and ranges a-b (either way round) in a line, within 1..k, sorted and distinct."""
    ints = lambda x: F.transform(F.regexp_extract_all(x, F.lit("[0-9]+"), F.lit(0)), lambda y: F.coalesce(y.try_cast("int"), F.lit(2147483647)))
    ranges = F.transform(F.regexp_extract_all(t, F.lit("[0-9]+\\s*[-–]\\s*[0-9]+"), F.lit(0)), ints)
    single = ints(t)
    inside = lambda i: F.array_contains(single, i) | F.exists(ranges, lambda r: (F.array_min(r) <= i) & (i <= F.array_max(r)))
    return F.when(k < 1, F.array().cast("array<int>")).otherwise(F.filter(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), inside))


def selection(t: Column, k: Column, top1: bool = False) -> Column:
    """X-14: struct(ids, tag): the clips a selector chose, of 1..k, and the fallback taken, if any.

    The last "SELECTED:" ("BEST:") line counts, of the text without thoughts or else of the raw text; ALL takes all. Without a usable line
    the one-clip mode takes the first video mentioned, else the first clip; the other mode takes all.
    """
    hits = lambda x: F.regexp_extract_all(x, F.lit(f"(?i){'BEST' if top1 else 'SELECTED'}\\s*:([^\\n]*)"), F.lit(1))
    bare = strip_think(t)
    line = lambda x: F.when(F.size(hits(x)) > 0, F.element_at(hits(x), -1)).otherwise("")
    pack = lambda ids, tag: F.named_struct(F.lit("ids"), ids, F.lit("tag"), F.lit(tag).cast("string"))
    every = F.sequence(F.lit(1), F.greatest(k, F.lit(1)))
    out = None
    for x in (line(bare), line(t)):
        ids = numbers(x, k)
        step = [] if top1 else [(x.rlike("(?i)\\bALL\\b"), pack(every, None))]
        for cond, value in [*step, (F.size(ids) > 0, pack(F.slice(ids, 1, 1) if top1 else ids, None))]:
            out = F.when(cond, value) if out is None else out.when(cond, value)
    if not top1:
        return out.otherwise(pack(every, "fallback:all"))
    said = F.transform(F.regexp_extract_all(bare, F.lit("[Vv]ideo\\s*([0-9]+)"), F.lit(1)), lambda y: y.try_cast("int"))
    said = F.filter(said, lambda y: (y >= 1) & (y <= k))
    return out.when(F.size(said) > 0, pack(F.slice(said, 1, 1), "fallback:video_mentions")).otherwise(pack(F.array(F.lit(1)), "fallback:first"))


def option_count(options: Column) -> Column:
    """X-15: number of options; a single string that holds two or more markers 'A. ' counts its distinct markers."""
    marks = F.array_distinct(F.regexp_extract_all(F.element_at(options, 1), F.lit(OPTION_MARK), F.lit(1)))
    return F.when((F.size(options) == 1) & (F.size(marks) >= 2), F.size(marks)).otherwise(F.size(options))


def letters_phrase(letters: Column) -> Column:
    """X-17: 'A or B', 'A, B, or C' up to six letters, beyond 'A, B, ..., or J'."""
    each = F.split(letters, "")
    n, at = F.length(letters), lambda i: F.substring(letters, i, 1)
    listed = F.concat(F.array_join(F.slice(each, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(", or "), F.right(letters, F.lit(1)))
    return F.when(n == 2, F.concat(at(1), F.lit(" or "), at(2))).when(n <= 6, listed).otherwise(F.concat(at(1), F.lit(", "), at(2), F.lit(", ..., or "), F.right(letters, F.lit(1))))


def safe_name(s: Column) -> Column:
    """X-18: a name without slashes."""
    return F.replace(s, F.lit("/"), F.lit("_"))


def category_of(path: Column, strategy: Column) -> Column:
    """X-18: what stands after _<strategy>_ in a file's stem."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), "\\.[^.]*$", "")
    mark = F.concat(F.lit("_"), strategy, F.lit("_"))
    at = F.instr(stem, mark)
    return F.when(at > 0, F.substr(stem, at + F.length(mark))).otherwise(stem)


def is_yesno(options: Column) -> Column:
    """F-15: all options are yes or no; an empty list is."""
    return F.forall(options, lambda o: F.lower(F.regexp_replace(pytrim(o), "^\\.+|\\.+$", "")).isin("yes", "no"))


def letters_of(n: Column) -> Column:
    """P-18: the letters of n options."""
    return F.when(n.between(2, 13), F.substring(F.lit(LETTERS), F.lit(1), n)).otherwise("ABCD")


def clean_null(v: Column) -> Column:
    """F-10: null for '', 'None' and 'null'."""
    t = pytrim(v)
    return F.when(t.isin("", "None", "null"), F.lit(None)).otherwise(t)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), "\\.[^.]*$", "")


def markdown(cols: list[Column], left: bool = True) -> Column:
    """K-06: a row of a Markdown table."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[c.cast("string") for c in cols]), F.lit(" |"))
