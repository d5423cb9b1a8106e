"""Sources and sinks: PDFs, Markdown, settings, device tables, paper directories."""
