"""Fixed schemas of the code relation; nothing is inferred."""

from __future__ import annotations

FILES = "snapshot string, path string, lang string, raw binary, text string"

#: One row for each declaration. sym is (file, ordinal in the file), so that ids are the same in every run.
SYMBOLS = (
    "snapshot string, sym string, ordinal int, name string, kind string, file string, line int, signature string, params array<string>, "
    "param_names array<string>, returns string, visibility string, container string, lang string, fields array<string>, calls array<string>, "
    "supers array<string>, permits array<string>, raises array<string>, bindings map<string,string>, decorators array<string>, size int"
)

TOKENS = "snapshot string, file string, token string, n long"

#: Rows of an experiment log that the reports read.
RUNS = (
    "cell_id string, pair_id string, experiment_id string, wave_id string, resolved_model string, task string, kind string, condition string, "
    "rep int, model string, effort string, runner_status string, acceptance_status string, acceptance_verdict string, manual_only boolean, "
    "reuse_judged boolean, accepted boolean, answer_ok boolean, scope_ok boolean, reused array<string>, duplicated array<string>, "
    "reads int, files_read int, searches int, edits int, turns int, tokens_in long, tokens_out long, runner_duration_seconds double, schema_version int"
)

TYPE_KINDS = tuple("class interface record enum type".split())
CALLABLE_KINDS = ("fn", "method")

#: Parts of names, and beginnings of quoted values, of constants whose value is never shown.
SECRET_NAMES = "|".join("APIKEY AUTH BEARER COOKIE CREDENTIALS? DSN KEY NONCE PASSWD PASSWORD PWD SALT SECRET SESSION SIGNATURE TOKEN".split())
SECRET_VALUES = "|".join("-----BEGIN AIza AKIA ASIA eyJ gho_ ghp_ github_pat_ glpat- pk- sk- xox[a-z]- ya29[.]".split())
LONGEST_VALUE = 24
