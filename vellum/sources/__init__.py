"""Reading PDF files: object syntax, cross-reference data and decryption."""
