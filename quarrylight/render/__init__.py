"""Reports as JSON, Markdown and console text."""
