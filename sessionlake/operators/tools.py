"""Tool calls and results of several providers' JSON in one shape, call and result pairs, skill loads, commits."""

from __future__ import annotations

import hashlib
import json
import posixpath
import re
import shlex
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SIGNALS = "session_id string, event_id string, ordinal long, subordinal int, signal string, call_id string, name string, arguments string, status string, text string, truncated boolean"

_FAILED = {"error", "failed", "failure", "cancelled", "canceled", "denied"}
_DONE = {"ok", "success", "completed", "complete", "succeeded"}
_CUT = re.compile(r"\[output truncated|\[truncated|lines omitted\]\s*$", re.IGNORECASE)


def _plain(value) -> str:
    """The text in nested content."""
    if value is None:
        return ""
    if isinstance(value, str):
        return value
    if isinstance(value, list):
        return "\n".join(filter(None, map(_plain, value)))
    if isinstance(value, dict):
        for key in ("text", "output", "content", "stdout"):
            if key in value:
                return _plain(value[key])
    return json.dumps(value, sort_keys=True, ensure_ascii=False)


def _status(node: dict, default: str) -> str:
    """failure over success over unknown, from flags, exit codes and words."""
    words = {str(node.get(k)).lower() for k in ("status", "state", "outcome") if node.get(k) is not None}
    exit_code = node.get("exit_code", (node.get("metadata") or {}).get("exit_code") if isinstance(node.get("metadata"), dict) else None)
    if node.get("is_error") is True or node.get("success") is False or words & _FAILED or (isinstance(exit_code, int) and exit_code != 0):
        return "failure"
    if node.get("is_error") is False or node.get("success") is True or words & _DONE or exit_code == 0:
        return "success"
    return default


def signals(content: str) -> list[dict]:
    """Calls and results of one event in order, each once; compacted and summarising parts are passed over."""
    try:
        root = json.loads(content)
    except ValueError:
        return []
    found: list[dict] = []

    def add(**signal) -> None:
        if signal not in found:
            found.append(signal)

    def call(call_id, name, arguments) -> None:
        add(signal="call", call_id=call_id and str(call_id), name=name, arguments=arguments if isinstance(arguments, str) else json.dumps(arguments, sort_keys=True, ensure_ascii=False), status=None, text=None, truncated=None)

    def result(call_id, node, output, default) -> None:
        text = _plain(output)
        add(signal="result", call_id=call_id and str(call_id), name=None, arguments=None, status=_status(node, default), text=text, truncated=bool(_CUT.search(text)))

    def visit(node) -> None:
        if isinstance(node, list):
            for x in node:
                visit(x)
            return
        if not isinstance(node, dict):
            return
        kind = str(node.get("type") or node.get("kind") or "").lower()
        if "compact" in kind or "summary" in kind:
            return
        if kind in ("tool_use", "tool-call", "toolcall"):
            call(node.get("id") or node.get("toolCallId"), node.get("name") or node.get("toolName"), node.get("input", node.get("arguments", node.get("args"))))
        elif kind in ("function_call", "custom_tool_call", "local_shell_call"):
            call(node.get("call_id") or node.get("id"), node.get("name") or kind, node.get("arguments", node.get("input", node.get("action"))))
        elif kind in ("tool_result", "tool-result", "toolresult"):
            result(node.get("tool_use_id") or node.get("toolCallId"), node, node.get("content", node.get("output")), "success")
        elif kind in ("function_call_output", "custom_tool_call_output"):
            result(node.get("call_id"), node, node.get("output"), "unknown")
        elif kind == "tool" and isinstance(node.get("state"), dict):
            state = node["state"]
            call(node.get("callID"), node.get("tool"), state.get("input"))
            if state.get("status") in ("completed", "error"):
                result(node.get("callID"), state, state.get("output", state.get("error")), "unknown")
        elif node.get("role") == "toolResult":
            result(node.get("toolCallId"), node, node.get("content"), "success")
        else:
            for x in node.get("tool_calls") or ():
                f = x.get("function") or x
                call(x.get("id"), f.get("name"), f.get("arguments"))
            for key in ("payload", "message", "content", "part", "parts"):
                if isinstance(node.get(key), (dict, list)):
                    visit(node[key])

    visit(root)
    return found


def normalise(events: DataFrame) -> DataFrame:
    """SIGNALS of events (session_id, event_id, ordinal, content). Events that hold none, or no JSON, give no rows."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SIGNALS.split(", ")]
        for frame in frames:
            rows = [{**s, "session_id": r.session_id, "event_id": r.event_id, "ordinal": r.ordinal, "subordinal": 10 + n} for r in frame.itertuples() for n, s in enumerate(signals(r.content or ""))]
            yield pd.DataFrame(rows, columns=names)

    return events.select("session_id", "event_id", "ordinal", "content").mapInPandas(work, SIGNALS)


def pairs(found: DataFrame) -> DataFrame:
    """Calls with their results: of one id in a session the first call, and the first result after it."""
    place = F.struct("ordinal", "subordinal")
    calls = found.filter("signal = 'call' and call_id is not null").groupBy("session_id", "call_id").agg(F.min_by(F.struct("event_id", "name", "arguments", place.alias("place")), place).alias("c"))
    late = found.filter("signal = 'result' and call_id is not null").withColumn("place", place).join(calls, ["session_id", "call_id"]).filter(F.col("place") > F.col("c.place"))
    results = late.groupBy("session_id", "call_id").agg(F.min_by(F.struct("event_id", "status", "text", "truncated", "place"), "place").alias("r"))
    return calls.join(results, ["session_id", "call_id"], "left").select("session_id", "call_id", F.col("c.event_id").alias("event_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.col("c.place.ordinal").alias("ordinal"), F.col("r.event_id").alias("result_event_id"), F.col("r.status").alias("status"), F.col("r.text").alias("text"), F.col("r.truncated").alias("truncated"))


def cat_path(command: str) -> str | None:
    """The file of a shell command that is cat with one plain argument."""
    if re.search(r"[|&;<>$`*?(){}\[\]~\n]", command):
        return None
    try:
        words = shlex.split(command)
    except ValueError:
        return None
    return words[1] if len(words) == 2 and words[0] == "cat" and not words[1].startswith("-") else None


_SKILL = re.compile(r"(?:^|/)skills/(?:.*/)?([^/]+)/SKILL\.md$")
SKILLS = "session_id string, event_id string, result_event_id string, call_id string, skill_name string, locator string, content_hash string, coverage string, load_kind string"


def _skill_load(arguments: str | None, name: str | None, text: str | None, truncated: bool | None, repository: str | None) -> dict | None:
    try:
        args = json.loads(arguments or "")
    except ValueError:
        args = {}
    args = args if isinstance(args, dict) else {}
    command = args.get("command") or args.get("cmd")
    command = command[-1] if isinstance(command, list) and command else command
    path, kind = (args.get("file_path") or args.get("path") or args.get("filePath")), "reader"
    if not path and isinstance(command, str):
        path, kind = cat_path(command), "cat"
    if not isinstance(path, str):
        return None
    bare = re.sub(r":\d+(-\d+)?$", "", path)
    virtual = re.fullmatch(r"skill://([A-Za-z0-9_.-]+)", bare)
    match = virtual or _SKILL.search(bare)
    if not match:
        return None
    partial = bare != path or truncated or any(args.get(k) not in (None, 0) for k in ("offset", "limit", "line_start", "line_end"))
    body = text or ""
    lines = body.split("\n")
    if all(re.match(r"\s*\d+[:→]", s) for s in lines if s.strip()) and body.strip():
        body = "\n".join(re.sub(r"^\s*\d+[:→]\s?", "", s) for s in lines)
    front = re.match(r"---\s*\n(.*?)\n---", body, re.DOTALL)
    named = re.search(r"^name:\s*[\"']?([^\"'\n]+?)[\"']?\s*$", front[1], re.MULTILINE) if front else None
    return {"skill_name": named[1] if named else match[1], "locator": bare if virtual else f"{repository}#{bare}" if repository else f"local:{bare}", "content_hash": None if partial else "sha256:" + hashlib.sha256(body.encode()).hexdigest(), "coverage": "partial" if partial else "complete", "load_kind": kind}


def skill_loads(paired: DataFrame) -> DataFrame:
    """SKILLS: successful reads of skill documents among pairs(), with a hash of what was read whole. An optional column repository names the locators."""
    if "repository" not in paired.columns:
        paired = paired.withColumn("repository", F.lit(None).cast("string"))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SKILLS.split(", ")]
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                load = _skill_load(r.arguments, r.name, r.text, r.truncated, r.repository)
                if load:
                    rows.append({"session_id": r.session_id, "event_id": r.event_id, "result_event_id": r.result_event_id, "call_id": r.call_id, **load})
            yield pd.DataFrame(rows, columns=names)

    return paired.filter("status = 'success'").select("session_id", "event_id", "result_event_id", "call_id", "name", "arguments", "text", "truncated", "repository").mapInPandas(work, SKILLS)


def skill_usage(observations: DataFrame, last: int = 5) -> DataFrame:
    """By locator: its most frequent name, sessions, loads, first and last, versions by hash, and the latest evidence."""
    names = observations.groupBy("locator", "skill_name").agg(F.count("*").alias("n"))
    named = names.groupBy("locator").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "skill_name"))), lambda s: s["skill_name"]).alias("names"))
    order = Window.partitionBy("locator").orderBy(F.desc_nulls_last("observed_at"), F.desc("event_id"))
    latest = observations.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= last).groupBy("locator").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "event_id"))), lambda s: s["event_id"]).alias("evidence"))
    counted = observations.groupBy("locator").agg(F.count_distinct("session_id").alias("sessions"), F.count("*").alias("loads"), F.min("observed_at").alias("first_at"), F.max("observed_at").alias("last_at"), F.count_distinct("content_hash").alias("versions"), F.count_if(F.col("coverage") == "complete").alias("complete"))
    return counted.join(named, "locator").join(latest, "locator").orderBy(F.desc("loads"), "locator")


class Shell:
    """A conservative reading of a shell command: simple commands with their joints, or none if anything is not understood."""

    _HEREDOC = re.compile(r"<<-?\s*(['\"]?)([A-Za-z_][A-Za-z0-9_]*)\1([^\n]*)\n(.*?)\n[ \t]*\2[ \t]*(?=\n|$)", re.DOTALL)

    def __init__(self, command: str):
        self.documents: list[str] = []

        def keep(m: re.Match) -> str:
            self.documents.append(m[4])
            return f" __HEREDOC_{len(self.documents) - 1}__{m[3]}\n"

        body = self._HEREDOC.sub(keep, command)
        self.segments: list[tuple[str, list[str]]] = []
        self.understood = not re.search(r"`|\$\(|\$\{", body)
        if not self.understood:
            return
        lexer = shlex.shlex(body.replace("\n", " ; "), posix=True, punctuation_chars=";&|<>")
        lexer.whitespace_split, lexer.commenters = True, ""
        joint, words = "", []
        try:
            for token in [*lexer, ";"]:
                if token in (";", "&&", "||", "|"):
                    if words:
                        self.segments.append((joint, words))
                    joint, words = token, []
                elif set(token) <= set(";&|"):
                    self.understood = False
                    return
                else:
                    words.append(token)
        except ValueError:
            self.understood = False
        if any(j in ("|", "||") for j, _ in self.segments):
            self.understood = False


def commit_message(words: list[str], documents: list[str], files: dict[str, str], cwd: str) -> str | None:
    """The message of a git commit's words: -m parts as paragraphs, or a file that is known."""
    parts, k = [], words.index("commit") + 1
    while k < len(words):
        w = words[k]
        if w in ("-m", "--message", "-am") and k + 1 < len(words):
            parts.append(words[k + 1])
            k += 1
        elif w.startswith("--message="):
            parts.append(w.split("=", 1)[1])
        elif w in ("-F", "--file") and k + 1 < len(words):
            path = words[k + 1]
            if path == "-" or path.startswith("__HEREDOC_"):
                return documents[0] if documents else None
            return files.get(posixpath.normpath(posixpath.join(cwd, path)))
        k += 1
    return "\n\n".join(parts) if parts else None


_HEADER = re.compile(r"^\[(?P<branch>[^\]]+?) (?:\(root-commit\) )?(?P<sha>[0-9a-f]{7,40})\] (?P<subject>.*)$", re.MULTILINE)
COMMITS = "session_id string, event_id string, result_event_id string, call_id string, cwd string, sha string, subject string, message string, normalized_message string"


def normal_message(message: str) -> str:
    return re.sub(r"\s+", " ", message).strip().lower()


def commits_of(calls: list[dict]) -> list[dict]:
    """Commits of one session's shell calls in order.

    Files that the session wrote give messages of commit -F; a write whose
    content is not sure, and any program that is not known, forget all files.
    """
    files: dict[str, str] = {}
    out = []
    for call in calls:
        try:
            args = json.loads(call["arguments"] or "")
        except ValueError:
            args = {}
        args = args if isinstance(args, dict) else {}
        path, content = args.get("file_path") or args.get("path"), args.get("content")
        if isinstance(path, str) and isinstance(content, str) and call["status"] == "success":
            files[posixpath.normpath(path)] = content
            continue
        command = args.get("command") or args.get("cmd")
        command = command[-1] if isinstance(command, list) and command else command
        if not isinstance(command, str):
            continue
        cwd = args.get("cwd") or args.get("workdir") or ""
        shell, messages = Shell(command), []
        if not shell.understood:
            files.clear()
        for n, (_, words) in enumerate(shell.segments if shell.understood else []):
            after = shell.segments[n + 1][0] if n + 1 < len(shell.segments) else ""
            if words[0] == "cd" and len(words) == 2:
                cwd = posixpath.normpath(posixpath.join(cwd, words[1]))
            elif words[0] == "git" and "commit" in words:
                messages.append((cwd, commit_message(words, shell.documents, files, cwd)))
            elif words[0] in ("printf", "echo", "cat") and ">" in words and words.index(">") + 1 < len(words):
                at = words.index(">")
                target = posixpath.normpath(posixpath.join(cwd, words[at + 1]))
                doc = next((shell.documents[int(w[10:-2])] for w in words if w.startswith("__HEREDOC_")), None)
                text = doc if words[0] == "cat" else " ".join(words[1:at])
                if after in ("&&", "") and text is not None:
                    files[target] = text
                else:
                    files.pop(target, None)
            elif words[0] not in ("git", "pwd", "echo", "printf", "cat", "ls"):
                files.clear()
        headers = list(_HEADER.finditer(call["text"] or "")) if call["status"] != "failure" else []
        for n, header in enumerate(headers if messages else []):
            where, message = messages[n] if len(headers) == len(messages) else (cwd, None)
            out.append({"event_id": call["event_id"], "result_event_id": call["result_event_id"], "call_id": call["call_id"], "cwd": where or None, "sha": header["sha"], "subject": header["subject"], "message": message, "normalized_message": normal_message(message or header["subject"])})
    return out


def commits(paired: DataFrame) -> DataFrame:
    """COMMITS of pairs(). Only calls that can matter (commits, writes and shell commands) are gathered, in order, by session; a session is one log file."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        rows = commits_of(frame.sort_values(["ordinal", "call_id"]).to_dict("records"))
        return pd.DataFrame([{"session_id": frame["session_id"].iloc[0], **r} for r in rows], columns=[c.split()[0] for c in COMMITS.split(", ")])

    return paired.filter("arguments rlike 'command|cmd|content'").select("session_id", "call_id", "event_id", "result_event_id", "arguments", "status", "text", "ordinal").groupBy("session_id").applyInPandas(work, COMMITS)
