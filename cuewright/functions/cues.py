"""Subtitle formats as Column expressions: text of a file to an array of cues and back.

A file is one row and its cues are one array, so that parsing, flagging, cleaning
and writing back is a projection: no shuffle, and position is the array index.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import DIGIT, SPACE
from .text import base_name, strip

# Line ends other than "\n" ("\r" is gone once a file is read).
_OTHER_LINE_ENDS = r"[\x0B\f\x1C-\x1E\x85\x{2028}\x{2029}]"

# Fixed values from here to ``SEPARATORS``: digits, time lines and file layout of the formats.
# Digits beyond the decimal ones (superscripts, circled and the like) also make an index line.
_DIGITS = (
    r"\p{Nd}\x{B2}\x{B3}\x{B9}\x{1369}-\x{1371}\x{19DA}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}"
    r"\x{2460}-\x{2468}\x{2474}-\x{247C}\x{2488}-\x{2490}\x{24EA}\x{24F5}-\x{24FD}\x{24FF}"
    r"\x{2776}-\x{277E}\x{2780}-\x{2788}\x{278A}-\x{2792}\x{10A40}-\x{10A43}\x{10E60}-\x{10E68}"
    r"\x{11052}-\x{1105A}\x{1F100}-\x{1F10A}"
)
INDEX_LINE = rf"\A[{_DIGITS}]+\z"


def _time_line(separators: str) -> str:
    time = rf"{DIGIT}{{2}}:{DIGIT}{{2}}:{DIGIT}{{2}}[{separators}]{DIGIT}{{3}}"
    return rf"({time})[{SPACE}]*-->[{SPACE}]*({time})"


SRT_TIME = _time_line(".,")
VTT_TIME = _time_line(".")

VTT_HEADER = "WEBVTT\n"
ASS_HEADER = "\n".join([
    "[Script Info]",
    "ScriptType: v4.00+",
    "WrapStyle: 0",
    "ScaledBorderAndShadow: yes",
    "Collisions: Normal",
    "",
    "[V4+ Styles]",
    "Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, "
    "Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, "
    "MarginL, MarginR, MarginV, Encoding",
    "Style: Default,Arial,20,&H00FFFFFF,&H000000FF,&H00000000,&H00000000,0,0,0,0,100,100,0,0,1,2,2,2,10,10,10,1",
    "",
    "[Events]",
    "Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text",
    "",
])

# Text between two cues (or runs of cues) of a written file.
SEPARATORS = {"srt": "\n", "vtt": "\n", "ass": ""}


def file_format(path: Column) -> Column:
    """Format by suffix, whatever its case; anything unknown is read as SRT."""
    suffix = F.lower(F.regexp_extract(base_name(path), r"\.[^.]*$", 0))
    return F.when(suffix == ".vtt", "vtt").when(suffix.isin(".ass", ".ssa"), "ass").otherwise("srt")


def _chunks(content: Column) -> Column:
    """Stripped blocks between blank lines, each as an array of lines."""
    lines = lambda chunk: F.split(F.regexp_replace(strip(chunk), _OTHER_LINE_ENDS, "\n"), "\n")
    return F.transform(F.split(content, rf"\n[{SPACE}]*\n"), lines)


def _cue(cue_index: Column, start: Column, end: Column, text: Column, raw: Column | None = None) -> Column:
    raw = F.lit(None).cast("string") if raw is None else raw
    return F.struct(
        cue_index.alias("cue_index"), start.alias("start"), end.alias("end"), text.alias("text"), raw.alias("raw")
    )


def srt_cues(content: Column) -> Column:
    """Cues of an SRT text: index line of digits, time line, at least one line of text."""
    def cue(lines: Column) -> Column:
        times = F.get(lines, F.lit(1))
        return _cue(
            strip(F.get(lines, F.lit(0))),
            F.regexp_extract(times, SRT_TIME, 1),
            F.regexp_extract(times, SRT_TIME, 2),
            F.array_join(F.slice(lines, 3, F.size(lines)), "\n"),
        )
    complete = F.filter(_chunks(content), lambda lines: F.size(lines) >= 3)
    return F.filter(F.transform(complete, cue), lambda c: (c["start"] != "") & c["cue_index"].rlike(INDEX_LINE))


def vtt_cues(content: Column) -> Column:
    """Cues of a WebVTT text; the first line holding a time decides, settings are dropped."""
    def timed(lines: Column) -> Column:
        at = F.array_position(F.transform(lines, lambda l: l.rlike(VTT_TIME)), True).cast("int")
        return F.struct(lines.alias("lines"), at.alias("at"))

    def cue(block: Column) -> Column:
        lines, at = block["lines"], block["at"]
        above = strip(F.get(lines, at - 2))
        times = F.get(lines, at - 1)
        return _cue(
            F.when((at > 1) & above.rlike(INDEX_LINE), above).otherwise(""),
            F.regexp_extract(times, VTT_TIME, 1),
            F.regexp_extract(times, VTT_TIME, 2),
            F.array_join(F.slice(lines, at + 1, F.size(lines)), "\n"),
        )
    body = F.regexp_replace(content, "(?msd)^WEBVTT.*?\n\n", "")
    return F.transform(F.filter(F.transform(_chunks(body), timed), lambda b: b["at"] > 0), cue)


def ass_cues(content: Column) -> Column:
    """Cues of an ASS or SSA text: every event line, comments included."""
    def event(line: Column) -> Column:
        fields = F.split(strip(F.regexp_replace(line, r"\A[A-Za-z]+:", "")), ",", 10)
        return F.struct(line.alias("line"), fields.alias("fields"))

    def cue(e: Column, i: Column) -> Column:
        field = lambda n: F.get(e["fields"], F.lit(n))
        return _cue(
            (i + 1).cast("string"),
            ass_time_ms(field(1)).cast("string"),
            ass_time_ms(field(2)).cast("string"),
            ass_plain_text(F.coalesce(field(9), F.lit(""))),
            e["line"],
        )
    lines = F.filter(F.transform(F.split(content, "\n"), strip), lambda l: l.rlike(r"\A(?:Dialogue|Comment):"))
    return F.transform(F.transform(lines, event), cue)


def ass_plain_text(c: Column) -> Column:
    """Text of an event without override tags, with its escapes resolved."""
    c = F.regexp_replace(c, r"\{[^}]*\}", "")
    c = F.replace(c, F.lit("\\h"), F.lit(" "))
    return F.replace(F.replace(c, F.lit("\\n"), F.lit("\n")), F.lit("\\N"), F.lit("\n"))


def ass_time_ms(c: Column) -> Column:
    pattern = r"(\d{1,2}):(\d{1,2}):(\d{1,2})[.:](\d{1,3})"
    part = lambda i: F.regexp_extract(c, pattern, i).try_cast("bigint")
    fraction = F.rpad(F.regexp_extract(c, pattern, 4), 3, "0").try_cast("bigint")
    return F.coalesce(((part(1) * 60 + part(2)) * 60 + part(3)) * 1000 + fraction, F.lit(0))


def time_ms(c: Column) -> Column:
    """Milliseconds of ``hh:mm:ss.mmm`` (or a comma); ASS times are milliseconds already."""
    c = F.translate(c, "۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩", "01234567890123456789")
    pattern = r"\A(\d{2}):(\d{2}):(\d{2})[.,](\d{3})\z"
    part = lambda i: F.regexp_extract(c, pattern, i).try_cast("bigint")
    return F.coalesce(((part(1) * 60 + part(2)) * 60 + part(3)) * 1000 + part(4), c.try_cast("bigint"))


def cue_array(fmt: Column, content: Column) -> Column:
    return (
        F.when(fmt == "vtt", vtt_cues(content)).when(fmt == "ass", ass_cues(content)).otherwise(srt_cues(content))
    )


# ---- back to text ---------------------------------------------------------------------


def srt_piece(c: Column) -> Column:
    return F.concat(c["cue_index"], F.lit("\n"), c["start"], F.lit(" --> "), c["end"], F.lit("\n"), c["text"], F.lit("\n"))


def vtt_piece(c: Column) -> Column:
    index = F.when(c["cue_index"] != "", F.concat(c["cue_index"], F.lit("\n"))).otherwise("")
    return F.concat(index, c["start"], F.lit(" --> "), c["end"], F.lit("\n"), c["text"], F.lit("\n"))


def ass_piece(c: Column) -> Column:
    """An event line made anew from its fields: the layer is a number (an SSA mark is layer 0), times have centiseconds,
    margins no leading zeros. A line that is not of ten fields gets the defaults of those it lacks."""
    def event(x: Column) -> Column:
        field = lambda n: strip(F.coalesce(F.get(x["fields"], F.lit(n)), F.lit("")))
        number = lambda n: F.coalesce(field(n).try_cast("bigint"), F.lit(0)).cast("string")
        style = F.coalesce(F.nullif(field(3), F.lit("")), F.lit("Default"))
        return F.concat(
            x["kind"], F.lit(": "), F.concat_ws(",", number(0), ass_time(ass_time_ms(field(1))), ass_time(ass_time_ms(field(2))), style, field(4),
                                                number(5), number(6), number(7), field(8)),
            F.lit(","), F.coalesce(F.get(x["fields"], F.lit(9)), F.lit("")), F.lit("\n"))
    parts = F.struct(F.regexp_extract(c["raw"], r"\A([A-Za-z]+):", 1).alias("kind"),
                     F.split(strip(F.regexp_replace(c["raw"], r"\A[A-Za-z]+:", "")), ",", 10).alias("fields"))
    return F.transform(F.array(parts), event)[0]


def ass_time(ms: Column) -> Column:
    """``h:mm:ss.cc``."""
    return F.format_string("%d:%02d:%02d.%02d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, F.floor(ms / 10) % 100)


def cue_piece(fmt: Column, c: Column) -> Column:
    """A cue as it stands in a written file of the format."""
    return F.when(fmt == "vtt", vtt_piece(c)).when(fmt == "ass", ass_piece(c)).otherwise(srt_piece(c))


def file_header(fmt: Column) -> Column:
    """What a written file opens with; null for SRT, which has no header."""
    return F.when(fmt == "vtt", VTT_HEADER).when(fmt == "ass", ASS_HEADER)


def separator(fmt: Column) -> Column:
    return F.when(fmt == "ass", SEPARATORS["ass"]).otherwise(SEPARATORS["srt"])


def render(fmt: Column, cues: Column) -> Column:
    """Text of a file from its cue array; indices are kept as they are, not renumbered."""
    vtt = F.array_join(F.concat(F.array(F.lit(VTT_HEADER)), F.transform(cues, vtt_piece)), "\n")
    ass = F.array_join(F.concat(F.array(F.lit(ASS_HEADER)), F.transform(cues, ass_piece)), "")
    srt = F.array_join(F.transform(cues, srt_piece), "\n")
    return F.when(fmt == "vtt", vtt).when(fmt == "ass", ass).otherwise(srt)


def replaced_raw(raw: Column, text: Column) -> Column:
    """Event line with its text field exchanged; null stays null (SRT and WebVTT)."""
    head = F.regexp_extract(raw, r"\A((?:[^,]*,){9})", 1)
    return F.concat(head, F.replace(text, F.lit("\n"), F.lit("\\N")))


def with_text(c: Column, text: Column) -> Column:
    """The cue with new text; index and times stay."""
    return c.withField("text", text).withField("raw", replaced_raw(c["raw"], text))
