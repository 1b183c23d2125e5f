"""What never enters the store: excluded applications and titles, the tool's own windows, shell chrome; and how private the rest is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of executables' names whose windows are never recorded.
EXCLUDED_APPS = ["1password", "bitwarden", "keepass", "lastpass", "dashlane", "signal", "whatsapp", "telegram", "credentialuibroker", "lockapp", "consent", "securityhealthhost"]
#: Titles that are never recorded.
EXCLUDED_TITLE = r"(?i)\b(password|mot de passe|bank|banque|login|sign in|connexion)\b"
#: Executables of the desktop itself.
IGNORED_APPS = ["searchhost", "shellexperiencehost", "startmenuexperiencehost", "textinputhost", "lockapp"]
#: Executables whose titles are ordinary work.
SAFE_TITLE_APPS = ["code", "cursor", "windsurf", "windowsterminal", "powershell", "pwsh", "cmd", "chrome", "msedge", "firefox", "com.microsoft.vscode", "com.google.chrome", "com.apple.terminal", "com.googlecode.iterm2"]
REPOSITORIES = 24


def excluded(app: Column, title: Column) -> Column:
    """Null applications and titles are of no excluded one."""
    parts = [F.contains(app, F.lit(a)) for a in EXCLUDED_APPS]
    hit = parts[0]
    for p in parts[1:]:
        hit = hit | p
    return F.coalesce(hit, F.lit(False)) | F.coalesce(F.rlike(title, F.lit(EXCLUDED_TITLE)), F.lit(False))


def recordable(samples: DataFrame, own_app: str | None = None) -> DataFrame:
    """Samples (app, title) that may be recorded, with a column privacy: normal for titles of known tools, else sensitive.

    Applications are compared in lower case without a closing .exe; rows without a title, of the desktop itself and of own_app are left out."""
    app = F.regexp_replace(F.lower(F.col("app")), r"\.exe$", "")
    kept = samples.where(~excluded(app, F.col("title")) & ~F.coalesce(app.isin(IGNORED_APPS), F.lit(False)) & (F.trim(F.coalesce("title", F.lit(""))) != ""))
    if own_app is not None:
        kept = kept.where(~app.eqNullSafe(F.lit(own_app.lower())))
    return kept.withColumn("privacy", F.when(app.isin(SAFE_TITLE_APPS), "normal").otherwise("sensitive"))


def recent_repositories(events: DataFrame, keys: list[str], limit: int = REPOSITORIES) -> DataFrame:
    """keys, repository, last_ms, rank: of each key the repositories used last."""
    used = events.where(F.col("repository").isNotNull()).groupBy(*keys, "repository").agg(F.max("ts_ms").alias("last_ms"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("last_ms"), "repository"))
    return used.withColumn("rank", rank).where(F.col("rank") <= limit)
