"""Column functions: text in, text, numbers, arrays or structs out."""
