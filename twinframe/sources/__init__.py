"""Reading datasets lazily: files, tables and queries, workbook archives."""
