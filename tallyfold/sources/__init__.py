from .profile import preview, schema_profile
from .readers import SCHEMAS, TABLES, load, read_csv, register_views
from .zipped import ZipCsv, read_zip_csv

__all__ = [
    "SCHEMAS", "TABLES", "ZipCsv", "load", "preview", "read_csv", "read_zip_csv", "register_views",
    "schema_profile",
]
