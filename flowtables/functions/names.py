"""Names, URNs, states and specification checks. Arguments and results are SQL expressions."""

from __future__ import annotations

# Fixed values.
RUN_STATES = ("pending", "accepted", "running", "queued", "retried", "success", "failed", "wait_upstream", "in_progress")
END_STATES = ("success", "failed", "retried")
JOB_EVENTS = ("sla_miss", "failure", "job_success")
OPERATOR_EVENTS = tuple(f"{o}_{s}" for o in ("task", "hook", "sensor") for s in ("start", "retry", "fail", "success"))
ONGOING_REPLAYS = ("created", "in progress", "partial replayed", "replayed")
PROJECT_NAME = "^[a-z][a-z0-9-]{4,28}[a-z0-9]$"
DATASET_NAME = "^[a-zA-Z0-9_]+$"
TABLE_NAME = "^[a-zA-Z0-9_-]+$"
MAX_JOB_NAME = 125


def quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def full_name(project: str, job: str) -> str:
    return f"concat({project}, '/', {job})"


def urn(kind: str, destination: str) -> str:
    return f"concat({kind}, '://', {destination})"


def table_urn(store: str, project: str, dataset: str, name: str) -> str:
    """A table of a dataset, or the dataset itself when the name is NULL."""
    return f"concat('{store}://', {project}, ':', {dataset}, coalesce(concat('.', {name}), ''))"


def upstream_project(name: str, own_project: str) -> str:
    """Project of a declared upstream name: its own prefix, else the declaring job's project."""
    return f"IF(instr({name}, '/') > 0, split_part({name}, '/', 1), {own_project})"


def upstream_job(name: str) -> str:
    return f"IF(instr({name}, '/') > 0, split_part({name}, '/', 2), {name})"


def run_state(text: str) -> str:
    return f"IF(lower({text}) IN ({quoted(RUN_STATES)}), lower({text}), NULL)"


def replay_user_state(state: str) -> str:
    return (
        f"CASE WHEN {state} IN ('in progress', 'partial replayed', 'replayed') THEN 'in progress' "
        f"WHEN {state} IN ('created', 'invalid', 'success', 'failed') THEN {state} ELSE '' END"
    )


def event_type(text: str) -> str:
    bare = f"regexp_replace(lower({text}), '^type_', '')"
    return f"IF({bare} IN ({quoted(JOB_EVENTS + OPERATOR_EVENTS)}), {bare}, NULL)"


def resource_name_error(full: str, is_dataset: str) -> str:
    """First complaint about ``project.dataset[.name]``, or NULL."""
    part = lambda i: f"get(split({full}, '[.]'), {i})"
    sections = f"size(split({full}, '[.]'))"
    return (
        f"CASE WHEN {sections} < 2 THEN 'too few sections' "
        f"WHEN NOT {part(0)} RLIKE '{PROJECT_NAME}' THEN 'bad project name' "
        f"WHEN NOT {part(1)} RLIKE '{DATASET_NAME}' THEN 'bad dataset name' "
        f"WHEN {is_dataset} THEN NULL WHEN {sections} <> 3 THEN 'wrong number of sections' "
        f"WHEN NOT {part(2)} RLIKE '{TABLE_NAME}' THEN 'bad table name' END"
    )


def job_spec_errors(name: str, start_date: str, version: str, owner: str, end_date: str | None = None) -> str:
    """All complaints about a job specification, as an array."""
    day = lambda c: f"({c} RLIKE r'^\\d{{4}}-\\d{{2}}-\\d{{2}}$' AND try_cast({c} AS DATE) IS NOT NULL)"
    checks = [
        f"IF(coalesce(length({name}), 0) = 0, 'name is empty', NULL)",
        f"IF(length({name}) > {MAX_JOB_NAME}, 'name is too long', NULL)",
        f"IF(NOT coalesce({day(start_date)}, false), 'start date is not yyyy-MM-dd', NULL)",
        f"IF(coalesce({version}, 0) <= 0, 'version must be positive', NULL)",
        f"IF(coalesce({owner}, '') = '', 'owner is empty', NULL)",
    ]
    if end_date:
        checks.append(f"IF({end_date} <> '' AND NOT {day(end_date)}, 'end date is not yyyy-MM-dd', NULL)")
    return f"array_compact(array({', '.join(checks)}))"
