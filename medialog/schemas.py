"""Table schemas and enumerations. Instants are TIMESTAMP in UTC."""

SHOWS = """id STRING, slug STRING, title STRING, description STRING, author_name STRING,
  author_email STRING, language STRING, itunes_category STRING, itunes_subcategory STRING,
  itunes_type STRING, explicit INT, cover_filename STRING, cover_width INT, cover_height INT,
  cover_format STRING, cover_mtime TIMESTAMP, feed_token STRING, status STRING,
  folder_missing_since TIMESTAMP, directory_listing STRING, last_scan_id BIGINT,
  created_at TIMESTAMP, updated_at TIMESTAMP"""

EPISODES = """id STRING, show_id STRING, filename STRING, identity_key STRING, title STRING,
  title_is_custom INT, tag_title STRING, description STRING, season INT, episode_number INT,
  episode_type STRING, explicit INT, pub_date TIMESTAMP, pub_date_is_custom INT,
  duration_seconds INT, bitrate_kbps INT, file_size_bytes BIGINT, file_mtime TIMESTAMP,
  mime_type STRING, status STRING, missing_since TIMESTAMP, removed_at TIMESTAMP,
  art_source STRING, art_filename STRING, art_sidecar_name STRING, art_sidecar_mtime TIMESTAMP,
  art_width INT, art_height INT, art_etag STRING, created_at TIMESTAMP, updated_at TIMESTAMP"""

MEDIA_ACCESS = """id BIGINT, episode_id STRING, show_id STRING, requested_at TIMESTAMP, kind STRING,
  status_code INT, bytes_sent BIGINT, total_bytes BIGINT, range_header STRING, client STRING,
  error STRING"""

SCAN_LOG = """id BIGINT, show_id STRING, started_at TIMESTAMP, finished_at TIMESTAMP, trigger STRING,
  files_found INT, added INT, updated INT, missing INT, removed INT, errors_json STRING,
  warnings_json STRING, note STRING"""

SCAN_DIAGNOSTICS = "show_id STRING, level STRING, file STRING, message STRING, code STRING"

LOGIN_ATTEMPTS = """id BIGINT, username STRING, attempted_at TIMESTAMP, succeeded INT, source STRING"""

REMOVED_FOLDERS = "slug STRING, removed_at TIMESTAMP"

SETTINGS = "instance_id STRING, key STRING, value STRING"

# One response as the web tier reports it, before enrichment.
RAW_REQUESTS = """request_id BIGINT, requested_at TIMESTAMP, show_id STRING, episode_id STRING,
  route STRING, file_name STRING, is_owner BOOLEAN, user_agent STRING, range_header STRING,
  status_code INT, aborted BOOLEAN, stated_bytes BIGINT, content_length BIGINT,
  total_bytes BIGINT, error STRING"""

# One file of a directory listing; the tag columns come from an upstream tag reader.
LISTING = """show_id STRING, filename STRING, size_bytes BIGINT, mtime TIMESTAMP, identity_key STRING,
  ordinal BIGINT, error_code STRING, tag_error BOOLEAN, tag_title STRING, tag_description STRING,
  tag_season INT, tag_episode_number INT, duration_seconds INT, bitrate_kbps INT"""

# The enumerations of the data model.
ACCESS_KINDS = ("download", "stream", "cover", "feed")
MEDIA_KINDS = ("download", "stream")
EPISODE_STATUSES = ("active", "missing", "expired", "removed")
LIVE_STATUSES = ("active", "missing")
SHOW_STATUSES = ("active", "folder_missing")
SCAN_TRIGGERS = ("watcher", "scheduled", "manual", "startup", "upload")
SCAN_OUTCOMES = ("problems", "errors", "clean", "changes", "running")
TIMELINE_EVENTS = ("added", "missing", "removed", "expired")
EPISODE_TYPES = ("full", "trailer", "bonus")
SHOW_TYPES = ("episodic", "serial")
DIRECTORY_LISTINGS = ("allowed", "blocked")
