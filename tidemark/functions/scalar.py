"""Scalar functions by kind. Each query evaluates a set of them over a table; inputs avoid values on which results may differ by rounding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.relational import _sql, t

R = "round({}, 9)".format
#: name -> (Spark expressions, DuckDB expressions or None where they are the same, table, key)
SETS: dict[str, tuple[dict[str, str], dict[str, str], str, str]] = {
    "fn_arithmetic": ({"a": "p_size + 1", "b": "p_size - 1", "c": "p_size * 3", "d": "p_size / 4.0D", "e": "p_size % 7", "f": "-p_size", "g": "abs(p_size - 25)", "h": "p_size & 12", "i": "p_size | 3", "j": "p_size ^ 5", "k": "~p_size", "l": "pmod(p_size - 30, 7)", "m": "greatest(p_size, 20)", "n": "least(p_size, 20)", "o": "p_size div 4", "q": "try_divide(p_size, p_size - p_size)", "r": "shiftleft(p_size, 2)", "s": "shiftright(p_size, 1)"}, {"d": "p_size / 4.0::DOUBLE", "j": "xor(p_size, 5)", "l": "((p_size - 30) % 7 + 7) % 7", "o": "(p_size // 4)::BIGINT", "q": "NULL::DOUBLE", "r": "p_size << 2", "s": "p_size >> 1"}, "part", "p_partkey"),
    "fn_math": ({k: R(v) for k, v in {"a": "sqrt(p_size)", "b": "cbrt(p_size)", "c": "exp(p_size / 10.0D)", "d": "ln(p_size)", "e": "log10(p_size)", "f": "log2(p_size)", "g": "sin(p_size)", "h": "cos(p_size)", "i": "tan(p_size)", "j": "asin(p_size / 51.0D)", "k": "acos(p_size / 51.0D)", "l": "atan(p_size)", "m": "atan2(p_size, 3)", "n": "degrees(p_size)", "o": "radians(p_size)", "p": "pow(p_size, 2)", "q": "sinh(p_size / 10.0D)", "r": "cosh(p_size / 10.0D)", "s": "tanh(p_size / 10.0D)", "t": "log1p(p_size)", "u": "expm1(p_size / 10.0D)", "v": "hypot(p_size, 3)", "w": "pi()", "x": "e()"}.items()} | {"y": "signum(p_size - 25.0D)", "z": "ceil(p_size / 4.0D)", "aa": "floor(p_size / 4.0D)", "ab": "rint(p_size / 4.0D + 0.1D)"}, {"c": R("exp(p_size / 10.0::DOUBLE)"), "j": R("asin(p_size / 51.0::DOUBLE)"), "k": R("acos(p_size / 51.0::DOUBLE)"), "q": R("sinh(p_size / 10.0::DOUBLE)"), "r": R("cosh(p_size / 10.0::DOUBLE)"), "s": R("tanh(p_size / 10.0::DOUBLE)"), "t": R("ln(p_size + 1)"), "u": R("exp(p_size / 10.0::DOUBLE) - 1"), "v": R("sqrt(p_size * p_size + 9)"), "x": R("exp(1)"), "y": "sign(p_size - 25.0::DOUBLE)::DOUBLE", "z": "ceil(p_size / 4.0::DOUBLE)::BIGINT", "aa": "floor(p_size / 4.0::DOUBLE)::BIGINT", "ab": "round(p_size / 4.0::DOUBLE + 0.1::DOUBLE)"}, "part", "p_partkey"),
    "fn_predicates": ({"a": "p_size = 7", "b": "p_size <> 7", "c": "p_size < 7", "d": "p_size <= 7", "e": "p_size > 7", "f": "p_size >= 7", "g": "nullif(p_size, 7) <=> NULL", "h": "nullif(p_size, 7) = 8", "i": "p_size IN (1, 2, 3)", "j": "NOT (p_size > 3 AND p_size < 9)", "k": "nullif(p_size, 7) IS NULL", "l": "nullif(p_size, 7) IS NOT NULL", "m": "coalesce(nullif(p_size, 7), -1)", "n": "if(p_size > 9, 'x', 'y')", "o": "CASE WHEN p_size > 9 THEN 1 WHEN p_size > 5 THEN 2 ELSE 3 END", "p": "CASE p_size WHEN 1 THEN 'one' WHEN 2 THEN 'two' END", "q": "nvl(nullif(p_size, 7), 0)", "r": "p_size BETWEEN 3 AND 9", "s": "nullif(p_size, 7) > 3 OR p_size = 7", "t": "nvl2(nullif(p_size, 7), 1, 2)"}, {"g": "nullif(p_size, 7) IS NOT DISTINCT FROM NULL", "q": "coalesce(nullif(p_size, 7), 0)", "t": "CASE WHEN nullif(p_size, 7) IS NOT NULL THEN 1 ELSE 2 END"}, "part", "p_partkey"),
    "fn_strings": ({"a": "upper(p_name)", "b": "lower(p_brand)", "c": "length(p_name)", "d": "concat(p_name, '-', p_type)", "e": "concat_ws('|', p_brand, p_type)", "f": "substring(p_name, 2, 3)", "g": "instr(p_name, 'a')", "h": "lpad(p_type, 12, '*')", "i": "rpad(p_type, 12, '*')", "j": "trim(concat('  ', p_type, ' '))", "k": "ltrim(concat('  ', p_type))", "l": "rtrim(concat(p_type, '  '))", "m": "reverse(p_name)", "n": "repeat(p_type, 2)", "o": "replace(p_name, 'a', 'A')", "p": "translate(p_name, 'abc', 'xyz')", "q": "p_name LIKE 'b%'", "r": "p_name RLIKE '^[a-m]'", "s": "regexp_replace(p_name, '[aeiou]', '#')", "t": "regexp_extract(p_brand, 'Brand#([0-9]+)', 1)", "u": "ascii(p_name)", "v": "startswith(p_name, 'b')", "w": "endswith(p_name, 'l')", "x": "contains(p_name, 'an')", "y": "initcap(p_type)", "z": "left(p_name, 3)", "aa": "right(p_name, 3)", "ab": "split_part(p_name, ' ', 1)", "ac": "levenshtein(p_type, 'PROMO')", "ad": "space(2) || p_type", "ae": "locate('e', p_name)", "af": "char_length(p_brand)"}, {"g": "instr(p_name, 'a')::INT", "r": "regexp_matches(p_name, '^[a-m]')", "s": "regexp_replace(p_name, '[aeiou]', '#', 'g')", "v": "starts_with(p_name, 'b')", "w": "ends_with(p_name, 'l')", "y": "upper(p_type[1]) || lower(p_type[2:])", "ad": "'  ' || p_type", "ae": "instr(p_name, 'e')::INT"}, "part", "p_partkey"),
    "fn_encodings": ({"a": "md5(p_name)", "b": "sha2(p_name, 256)", "c": "hex(p_size)", "d": "bin(p_size)", "e": "base64(cast(p_name as binary))", "f": "conv(cast(p_size as string), 10, 16)", "g": "cast(unhex(hex(p_name)) as string)", "h": "sha1(p_name)"}, {"b": "sha256(p_name)", "c": "upper(printf('%x', p_size))", "e": "base64(p_name::BLOB)", "f": "upper(printf('%x', p_size))", "g": "p_name", "d": "ltrim(bin(p_size), '0')"}, "part", "p_partkey"),
    "fn_dates": ({"a": "year(o_orderdate)", "b": "month(o_orderdate)", "c": "day(o_orderdate)", "d": "quarter(o_orderdate)", "e": "dayofyear(o_orderdate)", "f": "weekofyear(o_orderdate)", "g": "date_add(to_date(o_orderdate), 10)", "h": "date_sub(to_date(o_orderdate), 10)", "i": "datediff(to_date(o_orderdate), date'1995-01-01')", "j": "last_day(to_date(o_orderdate))", "k": "date_format(o_orderdate, 'yyyy-MM-dd')", "l": "trunc(to_date(o_orderdate), 'MM')", "m": "hour(o_orderdate)", "n": "minute(o_orderdate)", "o": "add_months(to_date(o_orderdate), 1)", "p": "dayofweek(o_orderdate)", "q": "make_date(2000, month(o_orderdate), 1)"}, {"g": "o_orderdate::DATE + 10", "h": "o_orderdate::DATE - 10", "i": "datediff('day', DATE '1995-01-01', o_orderdate::DATE)::INT", "j": "last_day(o_orderdate::DATE)", "k": "strftime(o_orderdate, '%Y-%m-%d')", "l": "date_trunc('month', o_orderdate)::DATE", "o": "(o_orderdate::DATE + INTERVAL 1 MONTH)::DATE", "p": "dayofweek(o_orderdate) + 1"}, "orders", "o_orderkey"),
    "fn_casts": ({"a": "cast(p_size as string)", "b": "cast(p_size as double)", "c": "try_cast(p_type as int)", "d": "cast(cast(p_retailprice as decimal(12,1)) as double)", "e": "cast('12' as int) + p_size", "f": "cast(p_size > 5 as int)", "g": "cast(p_size as bigint)", "h": "cast('1999-05-06' as date)", "i": "cast(cast(p_size as decimal(10,2)) as double)", "j": "cast(p_size as smallint)"}, {}, "part", "p_partkey"),
    "fn_arrays": ({"a": "size(split(p_name, ' '))", "b": "split(p_name, ' ')[0]", "c": "array_contains(split(p_name, ' '), 'blue')", "d": "array_join(array_sort(split(p_name, ' ')), ',')", "e": "element_at(split(p_name, ' '), -1)", "f": "array_max(array(p_size, 3, 9))", "g": "array_min(array(p_size, 3, 9))", "h": "array_position(array(1, p_size), p_size)", "i": "array_join(reverse(split(p_name, ' ')), ' ')", "j": "aggregate(sequence(1, p_size), 0, (x, y) -> x + y)", "k": "size(filter(sequence(1, p_size), x -> x % 2 = 0))", "l": "size(array_distinct(array(1, p_size, 1)))", "m": "named_struct('x', p_size, 'y', p_type).y", "n": "map('k', p_size)['k']", "o": "exists(sequence(1, p_size), x -> x = 9)", "q": "map_keys(map('k', p_size))[0]", "r": "array_join(transform(sequence(1, 3), x -> x * p_size), ',')", "s": "array_join(slice(sequence(1, 9), 2, 3), ',')"}, {"a": "len(string_split(p_name, ' '))::INT", "b": "string_split(p_name, ' ')[1]", "c": "list_contains(string_split(p_name, ' '), 'blue')", "d": "array_to_string(list_sort(string_split(p_name, ' ')), ',')", "e": "string_split(p_name, ' ')[-1]", "f": "greatest(p_size, 9)", "g": "least(p_size, 3)", "h": "(CASE WHEN p_size = 1 THEN 1 ELSE 2 END)::BIGINT", "i": "array_to_string(list_reverse(string_split(p_name, ' ')), ' ')", "j": "p_size * (p_size + 1) // 2", "k": "p_size // 2", "l": "CASE WHEN p_size = 1 THEN 1 ELSE 2 END", "m": "p_type", "n": "p_size", "o": "p_size >= 9", "q": "'k'", "r": "concat(p_size, ',', 2 * p_size, ',', 3 * p_size)", "s": "'2,3,4'"}, "part", "p_partkey"),
    "fn_json_url": ({"a": "cast(get_json_object(props, '$.k') as int)", "b": "from_json(props, 'k INT').k", "c": "to_json(named_struct('k', event_id))", "d": "parse_url(concat('http://h.example/p?q=', event_type), 'HOST')", "e": "parse_url(concat('http://h.example/p?q=', event_type), 'QUERY', 'q')", "f": "json_array_length('[1,2,3]')"}, {"a": "(props->>'$.k')::INT", "b": "(props->>'$.k')::INT", "c": "'{\"k\":' || event_id || '}'", "d": "'h.example'", "e": "event_type", "f": "3"}, "events", "event_id"),
    "fn_xpath": ({"a": "xpath_string(concat('<a><b>', p_size, '</b></a>'), 'a/b')", "b": "xpath_int(concat('<a><b>', p_size, '</b></a>'), 'a/b')", "c": "xpath_boolean('<a><b/></a>', 'a/b')", "d": "size(xpath('<a><b>1</b><b>2</b></a>', 'a/b/text()'))"}, {"a": "p_size::VARCHAR", "b": "p_size", "c": "true", "d": "2"}, "part", "p_partkey"),
    "fn_misc": ({"a": "format_number(p_retailprice, 2)", "b": "printf('%05d', p_size)", "c": "elt(2, 'x', p_type)", "d": "find_in_set(p_type, 'PROMO,SMALL')", "e": "field_one", "f": "typeof(p_size)", "g": "width_bucket(p_size, 0, 50, 5)", "h": "bround(p_size / 2.0D, 0)", "i": "soundex(p_type)"}, {}, "part", "p_partkey"),
}
del SETS["fn_misc"][0]["e"], SETS["fn_misc"][0]["i"]
SETS["fn_misc"][1].update({"a": "format('{:,.2f}', p_retailprice)", "b": "printf('%05d', p_size)", "c": "p_type", "d": "CASE p_type WHEN 'PROMO' THEN 1 WHEN 'SMALL' THEN 2 ELSE 0 END", "f": "'int'", "g": "(CASE WHEN p_size >= 50 THEN 6 ELSE p_size // 10 + 1 END)::BIGINT", "h": "round_even(p_size / 2.0::DOUBLE, 0)"})

#: name -> (Spark expression, DuckDB expression or None where it is the same), a function a line.
MORE: dict[str, tuple[str, str, dict[str, tuple[str, str | None]]]] = {
    "fn_more_casts": ("part", "p_partkey", {
        "tiny": ("cast(p_size as tinyint)", None),
        "single": ("cast(cast(p_size as float) as double)", "p_size::FLOAT::DOUBLE"),
        "truth": ("cast(p_size - 7 as boolean)", None),
        "truth_text": ("cast('true' as boolean)", None),
        "small_text": ("cast('12' as tinyint)", None),
        "same": ("positive(p_size)", "p_size"),
        "base_3": ("round(log(3, p_size), 9)", None),
        "tenths": ("round(p_size / 4.0D, 1)", "round(p_size / 4.0::DOUBLE, 1)"),
        "tens": ("round(p_size, -1)", "(CASE WHEN p_size % 10 >= 5 THEN p_size - p_size % 10 + 10 ELSE p_size - p_size % 10 END)::INT"),
    }),
    "fn_more_dates": ("orders", "o_orderkey", {
        "seconds": ("unix_timestamp(o_orderdate)", "epoch(o_orderdate::TIMESTAMP)::BIGINT"),
        "parsed": ("to_unix_timestamp('2001-02-03', 'yyyy-MM-dd')", "epoch(TIMESTAMP '2001-02-03')::BIGINT"),
        "shown": ("from_unixtime(unix_timestamp(o_orderdate), 'yyyy-MM-dd HH:mm:ss')", "strftime(o_orderdate::TIMESTAMP, '%Y-%m-%d %H:%M:%S')"),
        "second": ("second(o_orderdate)", "second(o_orderdate::TIMESTAMP)"),
    }),
    "fn_more_collections": ("part", "p_partkey", {
        "sorted": ("array_join(sort_array(split(p_name, ' '), false), ',')", "array_to_string(list_reverse_sort(string_split(p_name, ' ')), ',')"),
        "held": ("map_values(map('k', p_size))[0]", "p_size"),
        "place": ("array_position(array('PROMO', 'SMALL', 'LARGE'), p_type)", "coalesce(list_position(['PROMO', 'SMALL', 'LARGE'], p_type), 0)"),
        "sentences": ("size(sentences(concat(p_name, '. ', p_type, '!')))", "2"),
        "words": ("size(sentences(p_name)[0])", "len(string_split(p_name, ' '))"),
        "number": ("format_number(p_size * 1000.5D, 1)", "format('{:,.1f}', p_size * 1000.5::DOUBLE)"),
    }),
    "fn_more_xpath": ("part", "p_partkey", {
        "double": ("xpath_double(concat('<a><b>', p_size, '.5</b></a>'), 'a/b')", "p_size + 0.5::DOUBLE"),
        "float": ("cast(xpath_float(concat('<a><b>', p_size, '.5</b></a>'), 'a/b') as double)", "p_size + 0.5::DOUBLE"),
        "long": ("xpath_long(concat('<a><b>', p_size, '</b></a>'), 'a/b')", "p_size::BIGINT"),
        "short": ("xpath_short(concat('<a><b>', p_size, '</b></a>'), 'a/b')", "p_size::SMALLINT"),
    }),
}
for _name, (_table, _key, _functions) in MORE.items():
    SETS[_name] = ({k: x for k, (x, _) in _functions.items()}, {k: y for k, (_, y) in _functions.items() if y}, _table, _key)


def _select(columns: dict[str, str], table: str, key: str) -> str:
    return f"SELECT {key}, {', '.join(f'{v} AS {k}' for k, v in columns.items())} FROM {table}"


#: Sets that parse a document or text for each row and function: tens of microseconds each, where others take less than one.
PARSING = ("fn_xpath", "fn_more_xpath", "fn_more_collections")


def _spread(columns: dict[str, str], table: str, key: str) -> Callable[[SparkSession, str], DataFrame]:
    """The set over rows dealt to all tasks: a small file with many rows is read by few."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = t(spark, sf_dir, table)
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        return rows.repartition(tasks).selectExpr(key, *(f"{v} AS {k}" for k, v in columns.items()))

    return run


def queries() -> dict:
    return {n: (_spread(s, table, key) if n in PARSING else _sql(_select(s, table, key))) for n, (s, _, table, key) in SETS.items()}


def oracle_sql() -> dict[str, str]:
    return {n: _select(s | d, table, key) for n, (s, d, table, key) in SETS.items()}
