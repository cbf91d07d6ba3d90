"""The few places where Spark SQL and DuckDB spell the same expression differently.

Derived inputs are written once as SQL text and rendered for either engine."""

from __future__ import annotations


class SparkDialect:
    name = "spark"

    def __init__(self, sf_dir: str):
        self.sf_dir = sf_dir.rstrip("/")
        #: Query of the stored page objects, if a job keeps them.
        self.objects = ""

    def table(self, name: str) -> str:
        return f"parquet.`{self.sf_dir}/{name}.parquet`"

    def lit(self, text: str) -> str:
        return f'r"{text}"' if "'" in text else f"r'{text}'"

    def replace_all(self, expr: str, pattern: str, repl: str) -> str:
        return f"regexp_replace({expr}, {self.lit(pattern)}, {self.lit(repl)})"

    def extract_all(self, expr: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({expr}, {self.lit(pattern)}, {group})"

    def extract(self, expr: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract({expr}, {self.lit(pattern)}, {group})"

    def matches(self, expr: str, pattern: str) -> str:
        return f"({expr} rlike {self.lit(pattern)})"

    def json_text(self, expr: str, key: str) -> str:
        return f"get_json_object({expr}, '$.{key}')"

    def unnest(self, expr: str) -> str:
        return f"explode({expr})"

    def to_ts(self, expr: str) -> str:
        return f"timestamp_seconds({expr})"

    def pad4(self, expr: str) -> str:
        return f"format_string('%04d', CAST({expr} AS BIGINT))"

    def ntext(self, expr: str) -> str:
        return f"CAST({expr} AS STRING)"

    def string_agg(self, expr: str, sep: str, order: str) -> str:
        return f"listagg({expr}, '{sep}') WITHIN GROUP (ORDER BY {order})"


class DuckDialect:
    name = "duck"
    objects = ""

    def table(self, name: str) -> str:
        return name

    def lit(self, text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def replace_all(self, expr: str, pattern: str, repl: str) -> str:
        return f"regexp_replace({expr}, {self.lit(pattern)}, {self.lit(repl.replace('$', chr(92)))}, 'g')"

    def extract_all(self, expr: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({expr}, {self.lit(pattern)}, {group})"

    def extract(self, expr: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract({expr}, {self.lit(pattern)}, {group})"

    def matches(self, expr: str, pattern: str) -> str:
        return f"regexp_matches({expr}, {self.lit(pattern)})"

    def json_text(self, expr: str, key: str) -> str:
        return f"json_extract_string({expr}, '$.{key}')"

    def unnest(self, expr: str) -> str:
        return f"unnest({expr})"

    def pad4(self, expr: str) -> str:
        return f"printf('%04d', CAST({expr} AS BIGINT))"

    def ntext(self, expr: str) -> str:
        return f"CAST({expr} AS VARCHAR)"

    def string_agg(self, expr: str, sep: str, order: str) -> str:
        return f"string_agg({expr}, '{sep}' ORDER BY {order})"
