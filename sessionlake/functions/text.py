"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without weight in frequencies, and words that say nothing about a project.
STOPWORDS = ["a", "all", "also", "an", "and", "are", "as", "at", "be", "been", "but", "by", "can", "could", "do", "for", "from", "had", "has", "have", "he", "her", "here", "him", "his", "how", "i", "if", "in", "into", "is", "it", "its", "just", "me", "my", "no", "not", "of", "on", "or", "our", "please", "she", "should", "so", "that", "the", "their", "them", "then", "there", "these", "they", "this", "to", "up", "us", "was", "we", "were", "what", "when", "where", "which", "who", "why", "will", "with", "would", "you", "your"]
PROJECT_NOISE = ["agent", "branch", "check", "code", "continue", "done", "fix", "get", "good", "issue", "just", "look", "make", "need", "okay", "please", "proceed", "sure", "thing", "things", "use", "want", "work", "yes"]
FRUSTRATION = ["wtf", "gdi", "ffs", "fuck", "damn", "shit", "ugh"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def one_spaced(text: Column) -> Column:
    """Runs of white space, of any script, as one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def preview(text: Column, most: int) -> Column:
    """One line of at most `most` characters, then dots."""
    line = one_spaced(text)
    return F.when(F.char_length(line) > most, F.concat(F.substring(line, 1, most), F.lit("..."))).otherwise(line)


def without_fences(text: Column) -> Column:
    """Lines outside ``` fences; a fence that is not closed drops the rest. What lies between fence lines are the odd pieces."""
    return F.array_join(F.filter(F.split(text, r"(?m)^[^\S\n]*```[^\n]*$", -1), lambda piece, k: k % 2 == 0), "\n")


def words(text: Column) -> Column:
    """Frequency tokens: no fenced code, no URLs or paths, ASCII lower case, letters, digits and apostrophes; those with an ASCII digit go."""
    chunks = F.filter(F.split(without_fences(text), r"(?U)\s+"), lambda c: ~F.regexp_replace(c, r"^[()\[\]<>,;]+", "").rlike(r"^(/|~/)|://"))
    found = F.regexp_extract_all(F.array_join(chunks, " "), F.lit(r"[\p{IsAlphabetic}\p{N}']+"), F.lit(0))
    return F.filter(F.transform(found, lambda t: F.translate(t, UPPER, LOWER)), lambda t: ~t.rlike("[0-9]"))


def search_words(text: Column) -> Column:
    """Tokens of the search index before stemming: runs of letters and digits, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def html_text(html: Column) -> Column:
    """Tags dropped, an unclosed one to the end; white space collapsed."""
    return one_spaced(F.regexp_replace(html, r"<[^>]*(>|$)", " "))


def chunks(text: Column, size: int) -> Column:
    """A text in pieces of `size` characters, in one pass; an empty text has none."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def path_label(path: Column) -> Column:
    """The last non-empty segment of a path of either slash, else unknown."""
    parts = F.filter(F.split(path, r"[/\\]"), lambda p: p != "")
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("unknown"))


def after_wrapper(text: Column, rule: Column) -> Column:
    """What a human wrote after an image or command tag."""
    image = F.when(F.instr(text, ">") > 0, F.regexp_extract(text, r"(?s)^[^>]*>(.*)$", 1)).otherwise(text)
    command = F.when(F.instr(text, "</command-name>") > 0, F.regexp_extract(text, r"(?s)^.*?</command-name>(.*)$", 1)).otherwise(text)
    return F.when(rule == "tag.image", F.trim(image)).when(rule == "tag.command_name", F.trim(command)).otherwise(text)


def https_remote(remote: Column) -> Column:
    """A Git remote as https, without user and .git."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(remote), r"/+$", ""), r"\.git$", "")
    bare = F.regexp_replace(bare, r"^(ssh|git|https?)://([^@/]+@)?", "https://")
    return F.regexp_replace(bare, r"^([^@/:]+@)?([^/:]+):(?!//)", "https://$2/")


def frontmatter_name(text: Column) -> Column:
    """The name: field of a leading --- block, or null."""
    block = F.regexp_extract(text, r"(?s)^---\s*\n(.*?)\n---", 1)
    name = F.regexp_extract(block, r"""(?m)^name:\s*["']?([^"'\n]+?)["']?\s*$""", 1)
    return F.when(name != "", name)


def truncated(text: Column) -> Column:
    """Whether a tool's output says that it was cut."""
    return text.rlike(r"(?i)\[output truncated|\[truncated|lines omitted\]\s*$")


def unnumbered(text: Column) -> Column:
    """A listing without its line numbers, if all its non-empty lines have one."""
    lines = F.split(text, "\n", -1)
    full = F.filter(lines, lambda s: F.trim(s) != "")
    numbered = (F.size(full) > 0) & F.forall(full, lambda s: s.rlike(r"^\s*\d+[:→]"))
    return F.when(numbered, F.array_join(F.transform(lines, lambda s: F.regexp_replace(s, r"^\s*\d+[:→]\s?", "")), "\n")).otherwise(text)


def whole_surrogates(text: Column) -> Column:
    """JSON text whose unpaired surrogate escapes are replaced."""
    lone = r"(?i)(?<!\\)((?:\\\\)*)(?:\\u(d[89ab][0-9a-f]{2})(?!\\ud[c-f][0-9a-f]{2})|(?<!\\ud[89ab][0-9a-f]{2})\\u(d[c-f][0-9a-f]{2}))"
    return F.regexp_replace(text, lone, r"$1\\ufffd")


def clean_path(path: Column) -> Column:
    """A path without . and .. and doubled or trailing slashes; nothing above a root or a first folder."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda held, p: F.when(p == "..", F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(0)))).otherwise(F.concat(held, F.array(p))))
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))


def is_uuid(value: Column) -> Column:
    return value.rlike(r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")


def is_hex(value: Column, least: int = 1) -> Column:
    return value.rlike(rf"^[0-9a-fA-F]{{{least},}}$")
