"""A small one-file interpreter of the taint rules, to check the joins against."""

from __future__ import annotations

import re

from fernsift.operators import assignments as A
from fernsift.operators.taint import SANITIZERS, SINKS, TAINT_SOURCES


def words(s):
    return re.findall(r"\w+", s, re.A)


def split_params(s):
    return [p.strip() for p in s.split(",") if p.strip()]


class Model:
    def __init__(self, text: str):
        self.scopes = [{}]
        self.homes = {}
        self.text = text
        self.lines = text.split("\n")
        self.declare()
        self.assign()
        self.call()

    def look(self, name, upto=None):
        for scope in reversed(self.scopes[: None if upto is None else upto + 1]):
            if name in scope:
                return scope[name]
        return None

    def tainted(self, name):
        s = self.look(name)
        return s is not None and s["state"] == "TAINTED"

    def give(self, to, ref, line):
        src = self.look(ref)
        if src is to:
            return
        to.update(state="TAINTED", source=src["source"], line=src["line"],
                  steps=src["steps"] + [f"from {ref} at L{line}"])

    def new(self, name):
        self.scopes[-1][name] = s = {"state": "UNKNOWN", "source": None, "line": None, "steps": []}
        return s

    def declare(self):
        for n, raw in enumerate(self.lines, 1):
            line = raw.strip(" \t\n\r\f\x0b")
            if line.startswith(("//", "/*")):
                continue
            if m := re.match(A.FUNCTION, line, re.A):
                self.scopes.append({})
                params = split_params(m[2])
                for p in params:
                    self.new(p)
                self.homes[m[1]] = (params, len(self.scopes) - 1)
                continue
            if m := re.match(A.ARROW, line, re.A):
                self.homes[m[1]] = (split_params(m[2]), len(self.scopes) - 1)
            if m := re.match(A.DECLARATION.replace("(?d)", ""), line, re.A):
                sym = self.new(m[1])
                word = next((s for s in TAINT_SOURCES if s in m[2]), None)
                if word:
                    sym.update(state="TAINTED", source=word, line=n)
                washes = any(s in m[2] for s in SANITIZERS)
                for ref in words(m[2]):
                    if self.tainted(ref):
                        if washes:
                            sym.update(state="SANITIZED", source=None, line=None, steps=[])
                        else:
                            self.give(sym, ref, n)
            if m := re.match(A.DESTRUCTURING, line, re.A):
                hit = any(s in m[2] for s in TAINT_SOURCES)
                for prop, _ in re.findall(r"(\w+)(?:\s*:\s*(\w+))?", m[1], re.A):
                    sym = self.new(prop)
                    if hit:
                        sym.update(state="TAINTED", source=f"{m[2]}.{prop}", line=n)

    def assign(self):
        for _ in range(50):
            moved = False
            for n, raw in enumerate(self.lines, 1):
                line = raw.strip(" \t\n\r\f\x0b")
                m = re.match(A.ASSIGNMENT.replace("(?d)", ""), line, re.A)
                if not m or line.startswith(("const", "let", "var", "function")):
                    continue
                sym = self.look(m[1]) or self.new(m[1])
                if sym["state"] == "TAINTED":
                    continue
                ref = next((r for r in words(m[2]) if self.tainted(r)), None)
                if ref is None:
                    continue
                if any(s in m[2] for s in SANITIZERS):
                    moved |= sym["state"] != "SANITIZED"
                    sym["state"] = "SANITIZED"
                else:
                    self.give(sym, ref, n)
                    moved = True
            if not moved:
                return

    def call(self):
        for m in re.finditer(A.CALL, self.text, re.A):
            if m[1] in A.NOT_CALLS or m[1] not in self.homes:
                continue
            params, home = self.homes[m[1]]
            for i, arg in enumerate(split_params(m[2])):
                if i < len(params) and self.tainted(arg):
                    target = self.look(params[i], home)
                    src = self.look(arg)
                    if target is not None and target is not src:
                        target.update(state="TAINTED", source=src["source"], line=src["line"],
                                      steps=list(src["steps"]))

    def symbols(self):
        out = set()
        for k, scope in enumerate(self.scopes):
            for name, s in scope.items():
                credit = (s["source"], s["line"], tuple(s["steps"])) if s["state"] == "TAINTED" else (None, None, ())
                out.add((k, name, s["state"], *credit))
        return out

    def flows(self):
        out = set()
        for n, line in enumerate(self.lines, 1):
            for sink in SINKS:
                if sink in line:
                    for w in set(words(line)):
                        if self.tainted(w):
                            s = self.look(w)
                            out.add((sink, n, s["source"], s["line"], w, tuple(s["steps"])))
        return out
