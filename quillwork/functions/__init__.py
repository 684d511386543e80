"""quillwork.functions"""
