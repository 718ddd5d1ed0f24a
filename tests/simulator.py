"""A one-event-at-a-time model of trace assembly, for comparison with the Spark plans on small inputs."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Span:
    session: str
    kind: str
    name: str
    start_seq: int
    start_us: int
    parent_seq: int | None = None
    end_us: int | None = None
    reason: str | None = None

    def close(self, us: int, reason: str) -> None:
        if self.end_us is None:
            self.end_us, self.reason = us, reason


@dataclass
class Trace:
    session: str
    root: Span
    llm: Span
    last_us: int
    llm_open: bool = True
    tools: list = field(default_factory=list)  # open calls: (own session, tool, call id, span)
    runs: list = field(default_factory=list)  # open sub-agent spans
    ended_us: int | None = None


@dataclass
class Link:
    trace: Trace
    span: Span


class Simulator:
    def __init__(self, timeout_us: int | None):
        self.timeout_us = timeout_us
        self.active: dict[str, Trace] = {}
        self.links: dict[str, Link] = {}
        self.agents: dict[str, str] = {}
        self.latest: str | None = None
        self.spans: list[Span] = []
        self.resolved: dict[int, tuple] = {}

    # --- time ---
    def advance(self, now_us: int) -> None:
        for session, trace in list(self.active.items()):
            if trace.ended_us is not None:
                if now_us > trace.ended_us:
                    self.finish(trace, trace.ended_us, "agent_end")
            elif self.timeout_us is not None and now_us > trace.last_us + self.timeout_us:
                self.finish(trace, trace.last_us + self.timeout_us, "stale")

    def finish(self, trace: Trace, us: int, reason: str) -> None:
        for call in trace.tools:
            call[3].close(us, reason)
        for span in trace.runs:
            span.close(us, reason)
        if trace.llm_open:
            trace.llm.close(us, reason)
        trace.root.close(us, reason)
        for child in [c for c, link in self.links.items() if link.trace is trace]:
            del self.links[child]
        del self.active[trace.session]
        self.forget(trace.session)

    def forget(self, session: str) -> None:
        if self.latest == session:
            self.latest = None
        for agent in [a for a, s in self.agents.items() if s == session]:
            del self.agents[agent]

    def remember(self, session: str, agent: str | None = None) -> None:
        self.latest = session
        if agent:
            self.agents[agent] = session

    def span(self, *args, **kwargs) -> Span:
        span = Span(*args, **kwargs)
        self.spans.append(span)
        return span

    # --- events ---
    def run(self, events: list[dict]) -> list[Span]:
        events = sorted(events, key=lambda e: (e["us"], e["seq"]))
        for event in events:
            self.advance(event["us"])
            getattr(self, event["name"])(event)
        end = events[-1]["us"]
        self.advance(end)
        for trace in list(self.active.values()):
            self.finish(trace, end, "agent_end" if trace.ended_us is not None else "end_of_input")
        return self.spans

    def llm_input(self, e: dict) -> None:
        session = e.get("session")
        if not session:
            return
        self.remember(session, e.get("agent"))
        if session in self.active:
            self.finish(self.active[session], e["us"], "replaced")
        root = self.span(session, "root", f"{e['model']} · unknown", e["seq"], e["us"])
        llm = self.span(session, "llm", e["model"], e["seq"], e["us"])
        self.active[session] = Trace(session, root, llm, e["us"])

    def llm_output(self, e: dict) -> None:
        session = e.get("session")
        if not session:
            return
        self.remember(session, e.get("agent"))
        trace = self.active.get(session)
        if trace and trace.llm_open:
            trace.last_us = e["us"]
            trace.llm.close(e["us"], "ended")
            trace.llm_open = False

    def agent_end(self, e: dict) -> None:
        session = e.get("session")
        if not session:
            return
        self.remember(session, e.get("agent"))
        trace = self.active.get(session)
        if not trace:
            return
        for call in trace.tools:
            call[3].close(e["us"], "agent_end")
        for span in trace.runs:
            span.close(e["us"], "agent_end")
        trace.tools, trace.runs = [], []
        trace.ended_us = e["us"] if trace.ended_us is None else trace.ended_us

    def container(self, session: str | None):
        link = self.links.get(session)
        if link:
            return link.trace, link.span.start_seq
        trace = self.active.get(session)
        return (trace, None) if trace else None

    def before_tool_call(self, e: dict) -> None:
        session = e.get("session")
        if not session:
            return
        self.remember(session, e.get("agent"))
        home = self.container(session)
        if not home:
            return
        trace, parent = home
        trace.last_us = e["us"]
        span = self.span(trace.session, "tool", e["tool"], e["seq"], e["us"], parent)
        call = e.get("call") or None
        if call:
            for old in [c for c in trace.tools if c[0] == session and c[2] == call]:
                old[3].close(e["us"], "duplicate_id")
                trace.tools.remove(old)
        trace.tools.append((session, e["tool"], call, span))

    def after_tool_call(self, e: dict) -> None:
        session = e.get("session")
        if not session:
            how, agent = None, e.get("agent")
            if agent and self.agents.get(agent) in self.active:
                session, how = self.agents[agent], "agentId"
            elif len(self.active) == 1:
                session, how = next(iter(self.active)), "single active trace"
            elif self.latest in self.active:
                session, how = self.latest, "last active session"
            self.resolved[e["seq"]] = (session, how)
            if not session:
                return
        self.remember(session, e.get("agent"))
        home = self.container(session)
        if not home:
            return
        trace, _ = home
        trace.last_us = e["us"]
        call = e.get("call") or None
        match = [c for c in trace.tools if c[0] == session and call and c[2] == call]
        match = match or [c for c in trace.tools if c[0] == session and c[2] is None and c[1] == e["tool"]]
        if match:
            match[0][3].close(e["us"], "ended")
            trace.tools.remove(match[0])

    def find_home(self, e: dict, *others):
        home = self.container(e.get("requester")) if e.get("requester") else None
        if home:
            return home
        for key in others:
            if key and key in self.active:
                return self.active[key], None
        return None

    def create(self, e: dict, home, name: str, key: str | None) -> Span:
        trace, parent = home
        span = self.span(trace.session, "subagent", name, e["seq"], e["us"], parent)
        trace.runs.append(span)
        if key:
            self.links[key] = Link(trace, span)
        return span

    def subagent_spawning(self, e: dict) -> None:
        child = e.get("child")
        if not child:
            return
        old = self.links.pop(child, None)
        if old:
            old.span.close(e["us"], "reset")
        home = self.find_home(e, child)
        if home:
            self.remember(home[0].session)
            home[0].last_us = e["us"]
            self.create(e, home, f"subagent:{e.get('agent') or 'unknown'}", child)

    def _attach(self, e: dict, name: str) -> None:
        child = e.get("child")
        if not child:
            return
        link = self.links.get(child)
        home = (link.trace, None) if link else self.find_home(e, child)
        if home:
            self.remember(home[0].session)
            home[0].last_us = e["us"]
            if not link:
                self.create(e, home, name, child)

    def subagent_spawned(self, e: dict) -> None:
        self._attach(e, f"subagent:{e.get('agent') or 'unknown'}")

    def subagent_delivery_target(self, e: dict) -> None:
        self._attach(e, "subagent:delivery-target")

    def subagent_ended(self, e: dict) -> None:
        key = e.get("target") or e.get("child")
        link = self.links.get(key) if key else None
        home = (link.trace, None) if link else self.find_home(e, e.get("child"), key)
        if not home:
            return
        self.remember(home[0].session)
        home[0].last_us = e["us"]
        span = link.span if link else self.create(e, home, f"subagent:{e.get('kind') or 'unknown'}", None)
        span.close(e["us"], "ended")
        self.links.pop(key, None)
