"""How documents leave: Markdown, text, HTML, JSON and files."""
