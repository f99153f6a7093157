"""Compiling and running generated programs against test cases, in executor tasks.

Programs are foreign code: run this only on executors that are themselves sandboxed. Limits on CPU, memory, processes, file size and time
are set per run; they guard against accidents, not against attacks.
"""

from __future__ import annotations

import json
import os
import re
import resource
import shutil
import subprocess
import sys
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Statuses, signs of languages.
STATUSES = ("AC", "WA", "WA_CHECKER", "TLE", "RE", "CE", "NO_TESTS", "NO_CASES", "NO_OUTPUT", "JUDGE_ERROR", "UNSUPPORTED_LANG", "UNSUPPORTED_TYPE", "UNSUPPORTED_CANNOT_PARSE_SIGNATURE", "SKIPPED")
FOREIGN = re.compile(r"\buse\s+std::|\bfn\s+\w+\s*\([^)]*\)\s*->|for\s+_\s+in\s+\d+\.\.|let\s+mut\s+\w+|Vec<\w+>|\.unwrap\(\)", re.I)
CPP = re.compile(r"#include|using namespace std|\bint\s+main\s*\(")
PYTHON = re.compile(r"\A#!/usr/bin/env python|^\s*def\s+\w+\(", re.M)
WEAK = {"python": ((3, r"import "), (2, r"print\("), (2, r"(?m)^\s*if __name__\s*==")), "cpp": ((2, r"std::"), (2, r"bits/stdc\+\+\.h"), (2, r"(?m)^\s*cout\s*<<"))}
FOREIGN_BLOCK = re.compile(r"\buse\s+std::|\bfn\s+\w+\s*\(|for\s+_\s+in\s+\d+\.\.", re.I)
TAGGED = re.compile(r"<code_block>(.*?)</code_block>", re.S | re.I)
FENCE = re.compile(r"```([\w+\-]*)\n(.*?)\n```", re.S)
NAMES = {"py": "python", "python": "python", "python3": "python", "cpp": "cpp", "c++": "cpp", "cc": "cpp", "cxx": "cpp", "cplusplus": "cpp"}
FOREIGN_NAMES = frozenset("rust rs java javascript js go php ruby scala kotlin swift".split())
NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")

RESULT = "unique_key string, status string, lang string, passed int, total_tests int, case_status array<string>, detail string"


def pick_code(output: str) -> tuple[str | None, str]:
    """(language, code): the longest block of a known language, else of none, fenced ones before those in ``<code_block>`` tags on ties.

    Foreign blocks are passed over. Without blocks it is the whole text without such tags.
    """
    text = output or ""
    blocks = [(NAMES.get(name.lower()), body.strip("\n")) for name, body in FENCE.findall(text) if name.lower() not in FOREIGN_NAMES and body.strip()]
    for body in map(str.strip, TAGGED.findall(text)):
        if body and not FOREIGN_BLOCK.search(body):
            blocks.append(("cpp" if CPP.search(body) else "python" if PYTHON.search(body) else None, body))
    return max(blocks, key=lambda b: (b[0] is not None, len(b[1])), default=(None, TAGGED.sub(r"\1", text.strip())))


def language_of(code: str, stated: str | None) -> str | None:
    """``python``, ``cpp``, or null for a foreign language."""
    if stated:
        return stated
    if FOREIGN.search(code):
        return None
    if CPP.search(code):
        return "cpp"
    if PYTHON.search(code):
        return "python"
    weight = {lang: sum(w for w, p in signs if re.search(p, code)) for lang, signs in WEAK.items()}
    return "python" if weight["python"] > weight["cpp"] else "cpp"


def lines_of(text: str | None) -> list[str]:
    lines = [x.rstrip() for x in re.split(r"\r\n|\r|\n", text or "")]
    while lines and not lines[-1]:
        lines.pop()
    return lines


def close(a: float, b: float, tolerance: float) -> bool:
    gap = abs(a - b)
    return gap <= tolerance or (b != 0 and gap / max(abs(b), 1e-15) <= tolerance)


def same_output(got: str, expected: str, tolerance: float = 1e-6) -> bool:
    """Equal lines, or equally many tokens, each pair equal or both numbers within the absolute or relative tolerance."""
    if lines_of(got) == lines_of(expected):
        return True
    g, e = got.split(), (expected or "").split()
    return len(g) == len(e) and all(x == y or (NUMBER.fullmatch(x) and NUMBER.fullmatch(y) and close(float(x), float(y), tolerance)) for x, y in zip(g, e))


def same_json(a, b, tolerance: float = 1e-6) -> bool:
    """Equal structure; numbers, booleans among them, within the absolute tolerance."""
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return abs(float(a) - float(b)) <= tolerance
    if type(a) is not type(b):
        return False
    if isinstance(a, list):
        return len(a) == len(b) and all(same_json(x, y, tolerance) for x, y in zip(a, b))
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(same_json(a[k], b[k], tolerance) for k in a)
    return a == b


class Program:
    """A program in a folder of its own: built once, run for each case."""

    def __init__(self, code: str, lang: str, seconds: float, memory_mb: int):
        self.folder = tempfile.mkdtemp(prefix="case-")
        self.seconds, self.memory = seconds, memory_mb
        self.problem = None
        source = os.path.join(self.folder, "main.py" if lang == "python" else "main.cpp")
        with open(source, "w", encoding="utf-8", errors="replace") as f:
            f.write(code)
        self.command = [sys.executable, "-I", "-S", source]
        if lang == "cpp":
            self.command = [os.path.join(self.folder, "main.out")]
            try:
                built = subprocess.run(["g++", "-O2", "-std=gnu++17", "-pipe", source, "-o", self.command[0]], capture_output=True, timeout=60)
                self.problem = None if built.returncode == 0 else built.stderr.decode(errors="replace")[:4000]
            except (FileNotFoundError, subprocess.TimeoutExpired) as e:
                self.problem = f"the compiler failed: {type(e).__name__}"

    def _limits(self) -> None:
        cpu = max(1, min(30, int(self.seconds) + 1))
        resource.setrlimit(resource.RLIMIT_CPU, (cpu, cpu))
        resource.setrlimit(resource.RLIMIT_AS, (self.memory << 20, self.memory << 20))
        resource.setrlimit(resource.RLIMIT_FSIZE, (64 << 20, 64 << 20))

    def run(self, stdin: str, command: list[str] | None = None, seconds: float | None = None) -> tuple[str | None, str]:
        """(status or null, output or error); the environment holds nothing of the executor's but the path."""
        env = {"PATH": os.environ.get("PATH", ""), "OMP_NUM_THREADS": "1", "OPENBLAS_NUM_THREADS": "1", "PYTHONNOUSERSITE": "1"}
        try:
            done = subprocess.run(command or self.command, input=(stdin or "").encode(errors="replace"), capture_output=True, cwd=self.folder, env=env, timeout=seconds or self.seconds, preexec_fn=self._limits)
        except subprocess.TimeoutExpired:
            return "TLE", ""
        except OSError as e:
            return "RE", f"{type(e).__name__}: {e}"
        text = done.stdout.decode(errors="replace")
        return (None, text) if done.returncode == 0 else ("RE", done.stderr.decode(errors="replace")[:500])

    def close(self) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


CALL = """
import json, sys
ask = json.load(sys.stdin)
space = {}
exec(compile(open("main.py").read(), "main.py", "exec"), space)
call = space.get(ask["name"]) or getattr(space["Solution"](), ask["name"])
print(json.dumps(call(*ask["args"])))
"""


def judge_case(program: Program, mode: str, case: dict, fn_name: str | None, checker: str | None, tolerance: float) -> str:
    if mode == "function":
        with open(os.path.join(program.folder, "call.py"), "w") as f:
            f.write(CALL)
        args = json.loads(case.get("input") or "[]")
        status, out = program.run(json.dumps({"name": fn_name, "args": args if isinstance(args, list) else [args]}), [sys.executable, "-I", "-S", "call.py"])
        if status:
            return status
        try:
            return "AC" if same_json(json.loads(out.strip()), json.loads(case.get("output") or "null"), tolerance) else "WA"
        except ValueError:
            return "WA"
    paths = {n: os.path.join(program.folder, n) for n in ("input.txt", "output.txt", "expected.txt", "checker.py")}
    if mode == "file" or checker:
        with open(paths["input.txt"], "w") as f:
            f.write(case.get("input") or "")
    status, got = program.run("" if mode == "file" else case.get("input") or "")
    if status:
        return status
    if mode == "file":
        got = open(paths["output.txt"], errors="replace").read() if os.path.exists(paths["output.txt"]) else ""
    if checker:
        for name, text in (("output.txt", got), ("expected.txt", case.get("output") or ""), ("checker.py", checker)):
            with open(paths[name], "w") as f:
                f.write(text)
        status, said = program.run("", [sys.executable, "-I", paths["checker.py"], "input.txt", "expected.txt", "output.txt"], max(5.0, 3 * program.seconds))
        score = re.search(r"[-+]?\d*\.?\d+", said or "") if not status else None
        verdict = "AC" if score and float(score.group()) > 0 else "WA_CHECKER"
    else:
        verdict = "AC" if same_output(got, case.get("output") or "", tolerance) else "WA"
    for path in paths.values():
        if os.path.exists(path):
            os.remove(path)
    return verdict


def judge_row(row: dict, seconds: float = 10.0, memory_mb: int = 1024, stop_after: int = 10, tolerance: float = 1e-6) -> dict:
    """The verdict on one row of (unique_key, output, cases, mode, fn_name, checker, timeout_s, memory_limit_mb).

    The first status that isn't AC is the verdict; after ``stop_after`` cases in a row without AC the rest are skipped. C++ functions
    without a main are UNSUPPORTED_TYPE.
    """
    result = {"unique_key": row.get("unique_key"), "lang": None, "passed": 0, "total_tests": 0, "case_status": [], "detail": None}
    cases = row.get("cases")
    if cases is None:
        return result | {"status": "NO_CASES"}
    if not (row.get("output") or "").strip():
        return result | {"status": "NO_OUTPUT"}
    stated, code = pick_code(row["output"])
    lang = language_of(code, stated)
    cases, mode = [dict(c) for c in cases], row.get("mode") or "stdio"
    result |= {"lang": lang, "total_tests": len(cases)}
    if lang is None:
        return result | {"status": "UNSUPPORTED_LANG"}
    if not len(cases):
        return result | {"status": "NO_TESTS"}
    if mode == "function" and not row.get("fn_name"):
        return result | {"status": "UNSUPPORTED_CANNOT_PARSE_SIGNATURE", "detail": "no function is named"}
    if mode == "function" and lang == "cpp":
        return result | {"status": "UNSUPPORTED_TYPE", "detail": "C++ functions need a main"}
    limit = row.get("timeout_s")
    program = Program(code, lang, float(limit) if limit and limit == limit else seconds, int(row.get("memory_limit_mb") or memory_mb))
    try:
        if program.problem is not None:
            return result | {"status": "CE", "detail": program.problem}
        got: list[str] = []
        for case in cases:
            last = got[-stop_after:]
            got.append("SKIPPED" if len(last) == stop_after and "AC" not in last else judge_case(program, mode, case, row.get("fn_name"), row.get("checker"), tolerance))
        return result | {"case_status": got, "passed": got.count("AC"), "status": next((s for s in got if s != "AC"), "AC")}
    except Exception as e:  # noqa: BLE001
        return result | {"status": "JUDGE_ERROR", "detail": f"{type(e).__name__}: {e}"[:500]}
    finally:
        program.close()


def judge(df: DataFrame, retries: int = 2, **limits) -> DataFrame:
    """The verdicts on all rows, see ``judge_row``; a JUDGE_ERROR is tried again. Rows are judged where they lie; spread them first if they are few."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                for _ in range(retries + 1):
                    result = judge_row(row, **limits)
                    if result["status"] != "JUDGE_ERROR":
                        break
                out.append(result)
            yield pd.DataFrame(out, columns=["unique_key", "status", "lang", "passed", "total_tests", "case_status", "detail"])

    return df.mapInPandas(run, RESULT)
