"""Methods, jobs that are built once, and the timestamped log of what was built."""

from __future__ import annotations

import hashlib
import inspect
import json
import os
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any


class JobError(Exception):
    """A job can't be built as asked."""


METHODS: dict[str, Method] = {}
DEEPEST = 5


@dataclass
class Method:
    """A function with defaults for options, and the names of the datasets and jobs that it takes."""

    name: str
    run: Callable
    options: dict[str, Any]
    datasets: tuple[str, ...]
    jobs: tuple[str, ...]
    equivalent: tuple[str, ...] = ()

    @property
    def source_hash(self) -> str:
        return hashlib.sha1(inspect.getsource(self.run).encode()).hexdigest()


def method(options: dict[str, Any] | None = None, datasets: tuple[str, ...] = (), jobs: tuple[str, ...] = (), equivalent: tuple[str, ...] = ()):
    def wrap(f: Callable) -> Callable:
        METHODS[f.__name__] = Method(f.__name__, f, options or {}, datasets, jobs, equivalent)
        return f

    return wrap


@dataclass
class Job:
    id: str
    method: str
    fingerprint: str
    params: dict[str, Any]
    result: Any = None
    seconds: float = 0.0
    subjobs: list[str] = field(default_factory=list)
    current: bool = True
    kept: bool = False


@dataclass(frozen=True)
class Ref:
    """What a job of another session has of a dataset that it took."""

    id: str


class JobList(list):
    """Jobs in the order in which they were built."""

    def find(self, name: str) -> JobList:
        return JobList(j for j in self if j.method == name)

    def get(self, name: str, default=None):
        return (self.find(name) or [default])[-1]

    def as_tuples(self) -> list[tuple[str, str]]:
        return [(j.method, j.id) for j in self]

    def exectime(self) -> dict[str, float]:
        out: dict[str, float] = {}
        for j in self:
            out[j.method] = out.get(j.method, 0.0) + j.seconds
        return out | {"total": sum(j.seconds for j in self)}

    def pretty(self) -> str:
        return "\n".join(f"[{k:3}] {j.method} : {j.id}" for k, j in enumerate(self))


class Builder:
    """Builds jobs, or finds them: a job is reused if its method's source, options and inputs are the same and its subjobs are current."""

    def __init__(self, path: str | None = None):
        """``path`` is a file of jobs, as JSON lines, that outlive the session: those whose options and results JSON can hold, and whose inputs and subjobs are kept too."""
        self.path = path
        self.jobs: list[Job] = []
        self.made = JobList()
        self._depth: list[Job] = []
        if path and os.path.exists(path):
            with open(path) as f:
                for line in f:
                    self.jobs.append(self._restored(json.loads(line)))
        self._next = 1 + max((int(j.id.rpartition("-")[2]) for j in self.jobs), default=-1)

    def _restored(self, record: dict) -> Job:
        known = {j.id: j for j in self.jobs}
        value = lambda v: known.get(v["$id"], Ref(v["$id"])) if isinstance(v, dict) and set(v) == {"$id"} else v
        return Job(**record | {"params": {g: {k: value(v) for k, v in x.items()} for g, x in record["params"].items()}}, kept=True)

    def _keep(self, job: Job) -> None:
        kept = {j.id for j in self.jobs if j.kept}
        inputs = {getattr(v, "id", v) for v in job.params["jobs"].values() if v is not None}
        if self.path is None or not kept >= inputs | set(job.subjobs):
            return
        params = {g: {k: {"$id": v.id} if hasattr(v, "id") else v for k, v in x.items()} for g, x in job.params.items()}
        try:
            text = json.dumps({"id": job.id, "method": job.method, "fingerprint": job.fingerprint, "params": params, "result": job.result, "seconds": job.seconds, "subjobs": job.subjobs})
        except (TypeError, ValueError):
            return
        again = self._restored(json.loads(text))
        if self.fingerprint(job.method, again.params) != job.fingerprint or again.result != job.result:
            return
        with open(self.path, "a") as f:
            f.write(text + "\n")
        job.kept = True

    def params(self, name: str, kwargs: dict[str, Any]) -> dict[str, dict]:
        """Keywords by what the method says they are; unknown or ambiguous ones are errors."""
        m = METHODS.get(name)
        if m is None:
            raise JobError(f"no method {name}")
        groups: dict[str, dict] = {"options": dict(m.options), "datasets": dict.fromkeys(m.datasets), "jobs": dict.fromkeys(m.jobs)}
        for k, v in kwargs.items():
            where = [g for g, names in (("options", m.options), ("datasets", m.datasets), ("jobs", m.jobs)) if k in names]
            if len(where) != 1:
                raise JobError(f"{name}: {k} is {'ambiguous' if where else 'unknown'}")
            groups[where[0]][k] = v
        return groups

    def fingerprint(self, name: str, groups: dict[str, dict], source: str | None = None) -> str:
        plain = lambda v: v.id if hasattr(v, "id") else sorted(map(str, v)) if isinstance(v, (set, frozenset)) else repr(v)
        text = json.dumps([name, source or METHODS[name].source_hash, {g: {k: plain(v) for k, v in sorted(x.items())} for g, x in groups.items()}])
        return hashlib.sha1(text.encode()).hexdigest()

    def is_current(self, job: Job) -> bool:
        """Whether its method is as it was, and its subjobs are current."""
        m = METHODS.get(job.method)
        if m is None or not job.current or all(self.fingerprint(job.method, job.params, s) != job.fingerprint for s in (m.source_hash, *m.equivalent)):
            return False
        return all(self.is_current(j) for j in self.jobs if j.id in job.subjobs)

    def build(self, name: str, force: bool = False, **kwargs) -> Job:
        if len(self._depth) >= DEEPEST:
            raise JobError("subjobs are too deep")
        groups = self.params(name, kwargs)
        m = METHODS[name]
        prints = {self.fingerprint(name, groups, s) for s in (m.source_hash, *m.equivalent)}
        found = next((j for j in reversed(self.jobs) if j.fingerprint in prints and self.is_current(j)), None)
        if found is None or force:
            job = Job(f"{name}-{self._next}", name, self.fingerprint(name, groups), groups)
            self._next += 1
            self._depth.append(job)
            began = time.time()
            try:
                wanted = inspect.signature(m.run).parameters
                given = {**groups, "job": job, "builder": self, "params": groups}
                job.result = m.run(**{k: given[k] for k in wanted if k in given})
            finally:
                self._depth.pop()
            job.seconds = time.time() - began
            self.jobs.append(job)
            self._keep(job)
            found = job
        if self._depth:
            self._depth[-1].subjobs.append(found.id)
        else:
            self.made.append(found)
        return found

    def why_build(self, name: str, **kwargs) -> dict[str, dict[str, tuple]]:
        """The nearest jobs of the method and what differs, by job."""
        groups = self.params(name, kwargs)
        out = {}
        for j in self.jobs:
            if j.method == name:
                out[j.id] = {k: (j.params[g].get(k), v) for g, x in groups.items() for k, v in x.items() if repr(j.params[g].get(k)) != repr(v)}
        least = min((len(d) for d in out.values()), default=0)
        return {j: d for j, d in out.items() if len(d) == least}

    def chain(self, job: Job, length: int = -1, stop: str | None = None) -> list[Job]:
        """The job and those before it by ``jobs.previous``, oldest first."""
        out = []
        while job is not None and len(out) != length and job.id != stop:
            out.append(job)
            job = job.params["jobs"].get("previous")
        return out[::-1]


# ---- the log ----


def timestamp(value: int | str) -> tuple:
    """The place of a timestamp in the order: whole numbers, then dates by their text, and a date before itself with a number added."""
    if isinstance(value, int):
        if value < 0:
            raise ValueError("timestamps are not negative")
        return (0, value, "", 0)
    base, plus, extra = value.partition("+")
    if base.isdigit() and len(base) < 4:
        return (0, int(base), "", int(extra or 0))
    if not re.fullmatch(r"\d{4}(-\d\d(-\d\d([ T]\d\d(:\d\d(:\d\d(\.\d{1,6})?)?)?)?)?)?", base):
        raise ValueError(f"{value!r} is not a timestamp")
    return (1, 0, base.replace("T", " "), 1 + int(extra) if plus else 0)


@dataclass
class Entry:
    key: str
    timestamp: int | str
    joblist: list[tuple[str, str]]
    deps: dict[str, int | str]
    caption: str = ""
    ghost: bool = False


class BuildLog:
    """An append-only log of job lists by key and timestamp, kept as JSON lines and replayed at the start.

    Entries that are updated or truncated, and all that depend on them, become ghosts.
    """

    def __init__(self, path: str | None = None):
        self.path = path
        self.entries: dict[str, dict[tuple, Entry]] = {}
        self.ghosts: list[Entry] = []
        self._session: tuple[str, int | str, dict, bool] | None = None
        if path and os.path.exists(path):
            with open(path) as f:
                for line in f:
                    self._apply(json.loads(line))

    def _log(self, record: dict) -> None:
        self._apply(record)
        if self.path:
            with open(self.path, "a") as f:
                f.write(json.dumps(record) + "\n")

    def _apply(self, r: dict) -> None:
        if r["action"] == "add":
            e = Entry(r["key"], r["timestamp"], [tuple(x) for x in r["joblist"]], r["deps"], r.get("caption", ""))
            old = self.entries.setdefault(e.key, {}).get(timestamp(e.timestamp))
            self.entries[e.key][timestamp(e.timestamp)] = e
            if old is not None:
                self._ghost(old)
        else:
            for at in [t for t in self.entries.get(r["key"], {}) if t >= timestamp(r["timestamp"])]:
                self._ghost(self.entries[r["key"]].pop(at))

    def _ghost(self, entry: Entry) -> None:
        entry.ghost = True
        self.ghosts.append(entry)
        for entries in list(self.entries.values()):
            for at, e in list(entries.items()):
                if not e.ghost and e.deps.get(entry.key) is not None and timestamp(e.deps[entry.key]) == timestamp(entry.timestamp):
                    del entries[at]
                    self._ghost(e)

    def begin(self, key: str, at: int | str, update: bool = False) -> None:
        if self._session:
            raise JobError("a session is open already")
        timestamp(at)
        self._session = (key, at, {}, update)

    def abort(self) -> None:
        self._session = None

    def finish(self, joblist: JobList, caption: str = "") -> str:
        key, at, deps, update = self._session or (None, None, None, None)
        if key is None:
            raise JobError("no session is open")
        self._session = None
        jobs = [list(x) for x in joblist.as_tuples()]
        old = self.entries.get(key, {}).get(timestamp(at))
        if old is not None:
            if old.joblist == [tuple(x) for x in jobs] and old.deps == deps:
                return "unchanged"
            if not update:
                raise JobError(f"{key}/{at} would change; say update")
        self._log({"action": "add", "time": time.time(), "key": key, "timestamp": at, "joblist": jobs, "deps": deps, "caption": caption})
        return "updated" if old is not None else "new"

    def truncate(self, key: str, at: int | str) -> None:
        self._log({"action": "truncate", "time": time.time(), "key": key, "timestamp": at})

    def peek(self, key: str, wanted: int | str) -> Entry | None:
        """The entry at a timestamp, or nearest by ``<t``, ``<=t``, ``>t``, ``>=t``, "latest", "first"; ``<=`` takes a whole day if a day is given."""
        entries = sorted(self.entries.get(key, {}).items())
        if wanted == "latest":
            return entries[-1][1] if entries else None
        if wanted == "first":
            return entries[0][1] if entries else None
        m = re.match(r"(<=|>=|<|>)", wanted) if isinstance(wanted, str) else None
        if not m:
            return dict(entries).get(timestamp(wanted))
        text = wanted[m.end() :]
        t = timestamp(int(text) if text.isdigit() and len(text) != 4 else text)
        inside = lambda x: x[0] == 1 == t[0] and x[2].startswith(t[2]) and not t[3]
        if m[1] == "<":
            found = [e for x, e in entries if x < t]
        elif m[1] == "<=":
            found = [e for x, e in entries if x <= t or inside(x)]
        elif m[1] == ">":
            found = [e for x, e in entries if x > t and not inside(x)]
        else:
            found = [e for x, e in entries if x >= t]
        return (found[-1] if m[1][0] == "<" else found[0]) if found else None

    def get(self, key: str, wanted: int | str) -> Entry | None:
        """As :meth:`peek`, and the open session depends on it."""
        e = self.peek(key, wanted)
        if self._session and e is not None:
            self._session[2][key] = e.timestamp
        return e

    def since(self, key: str, at: int | str) -> list[int | str]:
        """The timestamps after one."""
        return [e.timestamp for x, e in sorted(self.entries.get(key, {}).items()) if x > timestamp(at)]

    def keys(self) -> list[str]:
        return sorted(k for k, v in self.entries.items() if v)
