"""Column functions: text, titles, math, images, Markdown structure, masking."""
