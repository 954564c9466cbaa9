"""Small differences between Spark SQL and the SQL of the checking engine.

An operator is a function from a dialect to one SELECT, so the plan that Catalyst gets and the
statement that checks it come from one definition.
"""

from __future__ import annotations


class Spark:
    name = "spark"

    def s(self, text: str) -> str:
        """A string literal without escapes."""
        return "r'" + text + "'" if "\\" in text else "'" + text.replace("'", "\\'") + "'"

    def replace(self, x, pattern, by):
        return f"regexp_replace({x}, {self.s(pattern)}, {self.s(by)})"

    def matches(self, x, pattern):
        return f"({x} rlike {self.s(pattern)})"

    def count(self, x, pattern):
        return f"regexp_count({x}, {self.s(pattern)})"

    def all(self, x, pattern):
        return f"regexp_extract_all({x}, {self.s(pattern)}, 0)"

    def first(self, x, pattern, group=0):
        return f"regexp_extract({x}, {self.s(pattern)}, {group})"

    def ascii_word(self, choices):
        """A whole word, with only ASCII letters, digits and _ as word characters."""
        return f"(?i)(?<![A-Za-z0-9_])({choices})(?![A-Za-z0-9_])"

    def split(self, x, sep):
        return f"split({x}, {self.s(chr(92) + 'Q' + sep + chr(92) + 'E')})"

    def size(self, a):
        return f"size({a})"

    def where(self, a, cond):
        return f"filter({a}, x -> {cond})"

    def map(self, a, expr):
        return f"transform({a}, x -> {expr})"

    def distinct(self, a):
        return f"array_distinct({a})"

    def common(self, a, b):
        return f"array_intersect({a}, {b})"

    def join(self, a, sep=" "):
        return f"array_join({a}, {self.s(sep)})"

    def slice(self, a, start, n):
        return f"slice({a}, {start}, {n})"

    def each(self, cols, rel, array, x="x", pos="pos"):
        """One row an element: cols, pos (from 0) and the element."""
        return f"SELECT {cols}, {pos}, {x} FROM {rel} LATERAL VIEW posexplode({array}) AS {pos}, {x}"

    def sha256(self, x):
        return f"sha2({x}, 256)"

    def days(self, late, early):
        return f"datediff({late}, {early})"

    def try_date(self, x):
        return f"try_to_date({x}, 'yyyy-MM-dd')"

    def prefix(self, x, p):
        return f"startswith({x}, {p})"

    def suffix(self, x, p):
        return f"endswith({x}, {p})"

    def list(self, *items):
        return f"array({', '.join(items)})"

    def gather(self, x, order):
        return f"transform(array_sort(collect_list(struct({order} AS o, {x} AS v))), s -> s.v)"

    def bit_count(self, x):
        return f"bit_count({x})"

    def xor(self, a, b):
        return f"({a} ^ {b})"

    def hex_long(self, x, digits=15):
        """The first hex digits of a digest as a number."""
        return f"cast(conv(substr({x}, 1, {digits}), 16, 10) AS bigint)"

    def shift_and(self, x, by, mask):
        return f"(shiftright({x}, {by}) & {mask})"

    def chars(self, x):
        return f"filter(split({x}, ''), x -> x <> '')"

    def max_by(self, v, k):
        return f"max_by({v}, {k})"

    def lev(self, a, b):
        return f"levenshtein({a}, {b})"

    def std(self, x):
        return f"stddev_pop({x})"

    def json(self, x, path):
        return f"get_json_object({x}, '$.{path}')"

    def try_int(self, x):
        return f"try_cast({x} AS bigint)"

    def ts(self, x):
        return f"to_timestamp_ntz({x})"

    def epoch(self, x):
        return f"unix_timestamp(cast({x} AS timestamp))"

    def values(self, alias, cols, rows):
        body = ", ".join("(" + ", ".join(r) + ")" for r in rows)
        return f"{alias} AS (SELECT * FROM VALUES {body} AS t({cols}))"


class Check(Spark):
    name = "check"

    def ascii_word(self, choices):
        return rf"(?i)\b({choices})\b"

    def s(self, text):
        return "'" + text.replace("'", "''") + "'"

    def replace(self, x, pattern, by):
        return f"regexp_replace({x}, {self.s(pattern)}, {self.s(by.replace('$1', chr(92) + '1'))}, 'g')"

    def matches(self, x, pattern):
        return f"regexp_matches({x}, {self.s(pattern)})"

    def count(self, x, pattern):
        return f"len(regexp_extract_all({x}, {self.s(pattern)}))"

    def all(self, x, pattern):
        return f"regexp_extract_all({x}, {self.s(pattern)})"

    def split(self, x, sep):
        return f"string_split({x}, {self.s(sep)})"

    def size(self, a):
        return f"len({a})"

    def where(self, a, cond):
        return f"list_filter({a}, lambda x: {cond})"

    def map(self, a, expr):
        return f"list_transform({a}, lambda x: {expr})"

    def distinct(self, a):
        return f"list_distinct({a})"

    def common(self, a, b):
        return f"list_intersect({a}, {b})"

    def join(self, a, sep=" "):
        return f"array_to_string({a}, {self.s(sep)})"

    def slice(self, a, start, n):
        return f"({a})[{start}:{start}+{n}-1]"

    def each(self, cols, rel, array, x="x", pos="pos"):
        return f"SELECT {cols}, unnest(range(len({array}))) AS {pos}, unnest({array}) AS {x} FROM {rel}"

    def sha256(self, x):
        return f"sha256({x})"

    def days(self, late, early):
        return f"date_diff('day', {early}, {late})"

    def try_date(self, x):
        return f"try_cast({x} AS DATE)"

    def prefix(self, x, p):
        return f"starts_with({x}, {p})"

    def suffix(self, x, p):
        return f"ends_with({x}, {p})"

    def list(self, *items):
        return f"[{', '.join(items)}]"

    def gather(self, x, order):
        return f"list({x} ORDER BY {order}, {x})"

    def xor(self, a, b):
        return f"xor({a}, {b})"

    def hex_long(self, x, digits=15):
        return f"('0x' || substr({x}, 1, {digits}))::BIGINT"

    def shift_and(self, x, by, mask):
        return f"(({x} >> {by}) & {mask})"

    def chars(self, x):
        return f"list_filter(string_split({x}, ''), lambda x: x <> '')"

    def json(self, x, path):
        return f"json_extract_string({x}, '$.{path}')"

    def try_int(self, x):
        return f"try_cast({x} AS BIGINT)"

    def ts(self, x):
        return f"cast({x} AS TIMESTAMP)"

    def epoch(self, x):
        return f"epoch({x})::BIGINT"

    def values(self, alias, cols, rows):
        body = ", ".join("(" + ", ".join(r) + ")" for r in rows)
        return f"{alias} AS (SELECT * FROM (VALUES {body}) t({cols}))"


def micro(x: str) -> str:
    """A real as a whole number of millionths, which both engines round alike."""
    return f"cast(floor(({x}) * 1000000 + 0.5) AS bigint)"


def corpus(d) -> str:
    """The item table over the driver's documents and labels, as the head of a WITH list."""
    title = f"substr({d.split('text', chr(10)) if d.name == 'check' else 'split(text, chr(10))'}{'[1]' if d.name == 'check' else '[0]'}, 1, 80)"
    number = f"cast(substr(source, 4) AS int)"
    return f"""corpus AS (
  SELECT d.doc_id AS id, {title} AS title, text AS content, lang AS language, source AS source_name,
    CASE {number} % 4 WHEN 0 THEN 'science_research' WHEN 1 THEN 'programming_engineering' WHEN 2 THEN 'knowledge_foundations' ELSE 'data_economics' END AS category,
    cast(coalesce(quality, 0.5) AS double) AS quality, concat('https://', source, '.example/', cast(d.doc_id AS string)) AS url
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def bare_corpus() -> str:
    """Spark's item table without the columns of labels, for tables of one row an item: no text is shuffled for a join."""
    return "corpus AS (SELECT doc_id AS id, substr(split(text, '\n')[0], 1, 80) AS title, text AS content, source AS source_name FROM documents)"


REGISTRY: dict[str, object] = {}


def operator(name: str):
    """Register a function from a dialect to SQL under a query name."""

    def add(build):
        REGISTRY[name] = build
        return build

    return add


PLANS: dict[str, object] = {}


def plan(name: str):
    """Register a function from a session, with the tables as views, to the DataFrame that Spark makes in place of the statement."""

    def add(build):
        PLANS[name] = build
        return build

    return add


def one_row_an_item(spark) -> bool:
    """No id of the item table stands in two rows; plans that count rows as items ask this, and leave the rest to the statement."""
    return not spark.sql(f"WITH {corpus(Spark())} SELECT id FROM corpus GROUP BY id HAVING count(*) > 1 LIMIT 1").count()


def run(spark, sf_dir: str, name: str, tables: dict | None = None):
    """The operator over the tables below sf_dir, or over the DataFrames given by name."""
    from lodestar.session import TABLES, table

    build = REGISTRY[name]
    sql = build(Spark())
    for t in TABLES:
        if tables and t in tables:
            tables[t].createOrReplaceTempView(t)
        elif t in sql:
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    return PLANS[name](spark) if name in PLANS else spark.sql(sql)
