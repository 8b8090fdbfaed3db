"""Dates and times: values are ISO texts, Julian days or timestamps; modifiers move them. All as SQL text, in UTC."""

from __future__ import annotations

import re

#: The year, in four digits at least and without a plus sign, which date_format puts before years of more digits.
_YEAR = "if(year({t}) BETWEEN 0 AND 9999, date_format({t}, 'yyyy'), cast(year({t}) AS string))"
_DATE = f"concat({_YEAR}, date_format({{t}}, '-MM-dd'))"
_DATETIME = f"concat({_YEAR}, date_format({{t}}, '-MM-dd HH:mm:ss'))"
#: What each code of strftime stands for, as an expression over a timestamp {t}.
CODES = {
    "d": "date_format({t}, 'dd')",
    "e": "lpad(cast(day({t}) AS string), 2, ' ')",
    "f": "concat(date_format({t}, 'ss'), '.', date_format({t}, 'SSS'))",
    "F": _DATE,
    "H": "date_format({t}, 'HH')",
    "I": "date_format({t}, 'hh')",
    "j": "date_format({t}, 'DDD')",
    "J": "cast(unix_micros({t}) / 86400000000D + 2440587.5D AS string)",
    "m": "date_format({t}, 'MM')",
    "M": "date_format({t}, 'mm')",
    "p": "date_format({t}, 'a')",
    "R": "date_format({t}, 'HH:mm')",
    "s": "cast(unix_seconds({t}) AS string)",
    "S": "date_format({t}, 'ss')",
    "T": "date_format({t}, 'HH:mm:ss')",
    "u": "cast((dayofweek({t}) + 5) % 7 + 1 AS string)",
    "w": "cast(dayofweek({t}) - 1 AS string)",
    "W": "lpad(cast(cast(floor((dayofyear({t}) + 6 - (dayofweek({t}) + 5) % 7) / 7) AS int) AS string), 2, '0')",
    "Y": _YEAR,
}


def timestamp(x: str, modifiers: list[str] = ()) -> str:
    """SQL text of the timestamp that ``x`` (SQL text) stands for, moved by the modifiers in turn."""
    mods = [m.strip().lower() for m in modifiers]
    number = f"try_cast(cast({x} AS string) AS double)"
    if x.strip().lower() == "'now'":
        t = "current_timestamp()"
    elif "unixepoch" in mods:
        t = f"timestamp_micros(cast(round({number} * 1000000D) AS bigint))"
    else:
        text = f"cast({x} AS string)"
        alone = f"if({text} RLIKE '^[0-9]{{2}}:[0-9]{{2}}', concat('2000-01-01 ', {text}), {text})"
        t = f"if({number} IS NOT NULL, timestamp_micros(cast(round(({number} - 2440587.5D) * 86400000D) AS bigint) * 1000L), try_to_timestamp({alone}))"
    for mod in mods:
        t = _moved(t, mod)
    return t


def _moved(t: str, mod: str) -> str:
    if mod in ("unixepoch", "auto", "localtime", "utc", "subsec", "subsecond", "julianday"):  # UTC is the only zone here
        return t
    if m := re.fullmatch(r"start of (day|month|year)", mod):
        return f"date_trunc('{m[1].upper()}', {t})"
    if m := re.fullmatch(r"weekday ([0-6])", mod):
        return f"timestampadd(DAY, pmod({m[1]} + 8 - dayofweek({t}), 7), {t})"
    if m := re.fullmatch(r"([+-]?\d+(?:\.\d+)?) (year|month|day|hour|minute|second)s?", mod):
        unit = m[2].upper()
        if unit in ("YEAR", "MONTH"):
            return f"timestampadd({unit}, {int(float(m[1]))}, {t})"
        seconds = float(m[1]) * {"DAY": 86400, "HOUR": 3600, "MINUTE": 60, "SECOND": 1}[unit]
        return f"timestampadd(MICROSECOND, {round(seconds * 1e6)}L, {t})"
    raise ValueError(f"no such date modifier: {mod!r}")


def date(x: str, modifiers: list[str] = ()) -> str:
    return _DATE.format(t=timestamp(x, modifiers))


def time(x: str, modifiers: list[str] = ()) -> str:
    return f"date_format({timestamp(x, modifiers)}, 'HH:mm:ss')"


def datetime(x: str, modifiers: list[str] = ()) -> str:
    return _DATETIME.format(t=timestamp(x, modifiers))


def julianday(x: str, modifiers: list[str] = ()) -> str:
    return f"(unix_micros({timestamp(x, modifiers)}) / 86400000000D + 2440587.5D)"


def unixepoch(x: str, modifiers: list[str] = ()) -> str:
    return f"unix_seconds({timestamp(x, modifiers)})"


def strftime(form: str, x: str, modifiers: list[str] = ()) -> str:
    t, parts, k = timestamp(x, modifiers), [], 0
    while k < len(form):
        if form[k] == "%" and k + 1 < len(form):
            parts.append("'%'" if form[k + 1] == "%" else CODES[form[k + 1]].format(t=t))
            k += 2
            continue
        end = form.find("%", k)
        piece = form[k : end if end > 0 else len(form)]
        parts.append("'" + piece.replace("'", "''") + "'")
        k += len(piece)
    return f"concat({', '.join(parts)})" if parts else "''"
