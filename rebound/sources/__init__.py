from rebound.sources.tables import (TABLES, config_table, ntz_to_timestamp, read_attempts_csv,
                                    read_config, read_table, table_path, write_table)

__all__ = ["TABLES", "config_table", "ntz_to_timestamp", "read_attempts_csv", "read_config",
           "read_table", "table_path", "write_table"]
