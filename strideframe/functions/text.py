"""Keys, names and labels: parsing, canonical forms, display strings."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------------------------
SESSIONS = ("T0", "T1")
CONDITIONS = ("SN", "DS")
RIGHT_SIDE = ("DX", "DESTRO", "RIGHT", "D")
LEFT_SIDE = ("SX", "SINISTRO", "LEFT", "L")
CONDITION_SIDE = {"DS": "DX", "SN": "SX"}
AFFECTED_ALIASES = ("lato piu colpito", "lato_piu_colpito", "lato più colpito", "latopiucolpito",
                    "affected_side", "affected side")
DOMINANCE_ALIASES = ("dominanza", "dominance", "dominant_side", "dominant side")
MUSCLE_SLOTS = (
    "Anterior Deltoid",
    "Teres Major",
    "Primo Interosseo",
    "Biceps brachii long head",
    "Triceps brachii lateral head",
    "Triceps brachii long head",
    "Trapezius Middle",
    "Infraspinatus",
    "Middle Deltoid",
    "Brachioradialis",
    "Posterior Deltoid",
    "Pectoralis Major",
    "Latissimus dorsi",
    "Biceps brachii short head",
)
MUSCLE_SYNONYMS = {
    "deltoide anteriore": "Anterior Deltoid",
    "deltoide medio": "Middle Deltoid",
    "deltoide posteriore": "Posterior Deltoid",
    "trapezio medio": "Trapezius Middle",
    "bicipite brachiale capo lungo": "Biceps brachii long head",
    "bicipite capo corto": "Biceps brachii short head",
    "biceps brachiale short head": "Biceps brachii short head",
    "tricipite brachiale capo laterale": "Triceps brachii lateral head",
    "tricipite brchiale capo lungo": "Triceps brachii long head",
    "infraspinato": "Infraspinatus",
    "pettorale": "Pectoralis Major",
}
NUMBER = r"[\d,]+(?:\.\d+)?"
SESSION_LAST = r"(?i)^Task_(SN|DS)_(T[01])$"
# Accelerometer names come as 'Muscle: Acc 5.X' or 'Muscle: ACC.X 14'.
_ACC = r"(?i)^(.+?):\s*Acc(?:[\.\s]*(\d+)\s*\.([XYZ])|\s*\.([XYZ])\s*(\d+))$"
# --------------------------------------------------------------------------------------------


def tolerant_double(c: Column) -> Column:
    """Text to DOUBLE, NULL when it does not parse."""
    return F.trim(c).try_cast("double")


def decimal_comma_double(c: Column) -> Column:
    """First number in a text such as '1259,2593 Hz'; a comma is the decimal mark, a sign is ignored."""
    number = F.nullif(F.regexp_extract(F.trim(c), NUMBER, 0), F.lit(""))
    return F.replace(number, F.lit(","), F.lit(".")).try_cast("double")


def session_of(name: Column) -> Column:
    """T0, else T1, else empty, by substring."""
    up = F.upper(F.trim(name))
    return F.when(up.contains("T0"), "T0").when(up.contains("T1"), "T1").otherwise("")


def condition_of(name: Column) -> Column:
    """SN, else DS, else empty, by substring."""
    up = F.upper(F.trim(name))
    return F.when(up.contains("SN"), "SN").when(up.contains("DS"), "DS").otherwise("")


def canonical_task(name: Column) -> Column:
    """'prefix_session_condition' when both can be read from the name, else the name unchanged."""
    s = F.trim(name)
    session, condition = session_of(s), condition_of(s)
    parts = F.filter(F.split(s, r"[_\-\s]+"), lambda p: ~F.upper(p).isin(*SESSIONS, *CONDITIONS))
    joined = F.array_join(parts, "_")
    prefix = F.when(F.size(parts) == 0, F.lit("Task")).otherwise(joined)
    return F.when((session == "") | (condition == ""), s).otherwise(F.concat_ws("_", prefix, session, condition))


def session_first(name: Column) -> Column:
    """'Task_DS_T1' becomes 'Task_T1_DS'; anything else is unchanged."""
    return F.regexp_replace(name, SESSION_LAST, r"Task_$2_$1")


def slug(c: Column, lower: bool = False, empty: str = "") -> Column:
    """Runs of non-alphanumerics become one underscore, none at the ends."""
    base = F.trim(c)
    base = F.lower(base) if lower else base
    out = F.regexp_replace(F.regexp_replace(base, r"[^0-9a-zA-Z]+", "_"), r"^_+|_+$", "")
    return F.when(out == "", F.lit(empty)).otherwise(out) if empty else out


def fold_name(name: str) -> str:
    """Lower-case, accent-free, single-spaced: for matching column headers on the driver."""
    flat = unicodedata.normalize("NFKD", str(name).strip().lower()).encode("ascii", "ignore").decode("ascii")
    return " ".join(flat.split())


def find_column(columns: Iterable[str], wanted: Sequence[str]) -> str | None:
    """First column whose folded header equals a wanted name; else one that contains it or is inside it."""
    folded = {fold_name(c): c for c in columns}
    names = [fold_name(w) for w in wanted]
    for n in names:
        if n in folded:
            return folded[n]
    for n in names:
        for header, original in folded.items():
            if header and (n in header or header in n):
                return original
    return None


def normal_side(c: Column) -> Column:
    """DX / SX from synonyms; other text comes back upper-cased."""
    up = F.upper(F.trim(c))
    return F.when(up.isin(*RIGHT_SIDE), "DX").when(up.isin(*LEFT_SIDE), "SX").otherwise(up)


def performed_side(condition: Column) -> Column:
    """DS -> DX, SN -> SX, DX and SX pass, anything else is NULL."""
    up = F.upper(F.trim(condition))
    return F.when(up == "DS", "DX").when(up == "SN", "SX").when(up.isin("DX", "SX"), up)


def muscle_name(c: Column) -> Column:
    """Canonical muscle name, or the trimmed input when it is not in the dictionary."""
    table = {**{m.lower(): m for m in MUSCLE_SLOTS}, **MUSCLE_SYNONYMS}
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, F.lower(F.trim(c))), F.trim(c))


def muscle_slot(c: Column) -> Column:
    """Fixed channel slot 1..14, NULL when unknown."""
    pos = F.array_position(F.array(*[F.lit(m.lower()) for m in MUSCLE_SLOTS]), F.lower(muscle_name(c)))
    return F.nullif(pos, F.lit(0)).cast("int")


def muscle_channel(c: Column, axis: Column | None = None) -> Column:
    """'<muscle>: EMG <slot>' or '<muscle>: Acc <slot>.<axis>'; NULL when unknown."""
    slot = muscle_slot(c)
    name = F.element_at(F.array(*[F.lit(m) for m in MUSCLE_SLOTS]), F.coalesce(slot, F.lit(1)))
    text = F.concat(name, F.lit(": EMG "), slot) if axis is None else F.concat(name, F.lit(": Acc "), slot, F.lit("."), axis)
    return F.when(slot.isNotNull(), text)


def acc_sensor(channel: Column) -> Column:
    """'<muscle>: Acc <number>' of an accelerometer channel in either spelling; NULL for others."""
    number = F.concat(F.regexp_extract(channel, _ACC, 2), F.regexp_extract(channel, _ACC, 5))
    return F.when(channel.rlike(_ACC), F.concat(F.trim(F.regexp_extract(channel, _ACC, 1)), F.lit(": Acc "), number))


def acc_axis(channel: Column) -> Column:
    """X, Y or Z of an accelerometer channel; NULL for others."""
    axis = F.upper(F.concat(F.regexp_extract(channel, _ACC, 3), F.regexp_extract(channel, _ACC, 4)))
    return F.when(channel.rlike(_ACC), axis)


def acc_to_emg(channel: Column) -> Column:
    """Name of the EMG channel that sits on the same sensor."""
    return F.replace(acc_sensor(channel), F.lit(": Acc "), F.lit(": EMG "))


def channel_kind(channel: Column) -> Column:
    """emg, acc, gyro or other, from the channel name."""
    up = F.upper(channel)
    return (
        F.when(up.contains("GYRO"), "gyro").when(up.contains("ACC"), "acc").when(up.contains("EMG"), "emg").otherwise("other")
    )


def display_name(channel: Column) -> Column:
    """Part of a channel name before the colon."""
    return F.trim(F.split(channel, ":")[0])


def p_label(p: Column, letter: str = "p") -> Column:
    """'p<0.001', 'p=0.012' or 'p=n/a'."""
    return (
        F.when(p.isNull() | F.isnan(p), f"{letter}=n/a").when(p < 0.001, f"{letter}<0.001")
        .otherwise(F.concat(F.lit(f"{letter}="), F.format_string("%.3f", p)))
    )


def delta_label(d: Column) -> Column:
    """Signed difference with three decimals."""
    sign = F.when(d >= 0, "+").otherwise("")
    return F.when(d.isNull() | F.isnan(d), "Δ=n/a").otherwise(F.concat(F.lit("Δ="), sign, F.format_string("%.3f", d)))


def short_task(name: Column) -> Column:
    """'Task_T0_DS' -> 'T0_DS'; other names are cut to ten characters (a display label)."""
    pattern = r"(?i)^Task[_\-]?(.+)"
    return F.when(name.rlike(pattern), F.regexp_extract(name, pattern, 1)).otherwise(F.substring(name, 1, 10))


def json_list(c: Column) -> Column:
    """JSON list of text; NULL or malformed gives an empty list."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def json_numbers(values: Column) -> Column:
    """ARRAY<DOUBLE> to JSON with six decimals and NULL for missing."""
    return F.to_json(F.transform(values, lambda v: F.round(v, 6)), {"ignoreNullFields": "false"})


def split_list(text: str | None) -> list[str]:
    """Comma, semicolon or newline separated option text to names."""
    raw = (text or "").replace(";", ",").replace("\n", ",").split(",")
    return [p.strip() for p in raw if p.strip()]
