"""Writers: tables, reports and interchange files."""
